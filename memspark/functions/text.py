"""Text rules as column expressions.

Every rule is a pattern over lower-cased text that Java's and RE2's engines read alike, so the same tables
serve the jobs and their oracles.  Words are bounded by anything but a-z, 0-9 and the apostrophe.

Words are closed classes of English grammar (pronouns, conjunctions, prepositions, question words) and common verbs.
Lists on which scores and categories depend, so that they have to hold just these words, are marked as fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _Z = r"(^|[^a-z0-9'])", r"($|[^a-z0-9'])"


def word(alternatives: str) -> str:
    """A pattern for any of the alternatives as whole words."""
    return f"{_A}({alternatives}){_Z}"


def begins(alternatives: str) -> str:
    return f"^({alternatives}){_Z}"


def ends(alternatives: str) -> str:
    return f"{_A}({alternatives})$"


_DIGIT = (r"(^|[^0-9])", r"($|[^0-9])")


def _cut(pattern: str) -> list[str]:
    """The alternatives of a pattern, as far as they are in no bracket."""
    parts, depth = [""], 0
    for i, c in enumerate(pattern):
        plain = pattern[i - 1 : i] != "\\"
        depth += plain * ((c in "([") - (c in ")]")) if "[(" not in pattern[max(0, i - 1) : i + 1] or c == "[" else 0
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _firsts(pattern: str) -> str:
    """Members of a class of all characters that a match can begin with; for words, figures, simple classes and groups."""
    out = ""
    for p in _cut(pattern):
        end = 1
        if p[0] == "(":
            end = next(i for i in range(1, len(p) + 1) if len(_cut(p[:i] + "|")) == 2)
            out += _firsts(p[1 : end - 1].removeprefix("?:"))
        elif p[0] == "[":
            end = p.index("]") + 1
            out += p[1 : end - 1]
        else:
            out += p[0]
        if p[end : end + 1] == "?":
            out += _firsts(p[end + 1 :])
    return "".join(dict.fromkeys(out)) if "-" not in out else out


def _quick(part: str) -> str:
    """One alternative of a pattern for the same texts, in Java's syntax, but read in one pass over a text.

    What may stand before and behind is looked at and not consumed, and only where a first letter fits; of what stands before
    ".*" the first place counts, for whatever follows a later one follows that one as well.
    """
    if part.startswith("^") or "[(" in part:
        return part
    for (a, z), c in (((_A, _Z), "a-z0-9'"), (_DIGIT, "0-9")):
        part = part.replace(".*" + a, f".*[^{c}]")
        part = part.removesuffix(z) + f"(?![{c}])" if part.endswith(z) else part
        if part.startswith(a):
            rest = part[len(a) :]
            part = f"(?=[{_firsts(rest.split('.*')[0])}])(?<![{c}]){rest}"
    head, some, tail = part.partition(".*")
    return f"(?s)^(?>.*?{head}).*{tail}" if some else part


def found(text: Column, pattern: str) -> Column:
    """Whether a text has a match, as ``rlike`` says, by the alternatives in turn."""
    return reduce(lambda a, b: a | b, (text.rlike(_quick(p)) for p in _cut(pattern)))


# Grammar: conjunctions that open a clause, prepositions and conjunctions that can't end one, subject pronouns.
_OPENERS = "although|and|as|because|but|if|nor|or|since|so|than|though|unless|until|whereas|which|while|whose|yet"
_DANGLING = "a|an|and|as|at|because|but|by|for|from|if|in|into|nor|of|on|or|than|that|the|to|which|with|without"
_THIRD = "he|her|him|his|she|their|them|they"
_TALK = "chat|conversation|dialogue|discussion|exchange|session|thread"
# Nouns for somebody unnamed.
_PERSON, _SOMEBODY = "person", "person|subject|man|woman|girl|boy|guy|lady"
_SERVICE = "as an? (ai|assistant|language model)|(glad|happy|here) to (assist|help)|i (can|could|will) (assist|check|find|help|look|search)|i'll (assist|check|find|help|look|search)|i'm (an ai|sorry, but)|let me (check|find|help|know|look|search|see)"
_TRIVIAL = "back|busy|done|fine|free|good|here|hungry|late|ok|okay|out|ready|sick|sure|there|tired|well"

#: Quality flags of a candidate text; the first six keep it from becoming active.
FLAGS = {
    # too short, an assistant's phrase, a passing state as a fact, a clause without its sentence, or cut off
    "junk": rf"^.{{0,9}}$|{word(_SERVICE)}|^user (is|has|uses) ({_TRIVIAL})[.!]?$|^({_OPENERS}) [^ ]+ [^ ]+$|[(,]\s*$",
    "assistant_language": word(_SERVICE),
    "wrong_subject": rf"^(the )?user is (an? |the )?(agent|ai|assistant|bot|chatbot|language model){_Z}",
    "unanchored_subject": word(rf"(the) ({_SOMEBODY})|(that|this) ({_PERSON})") + "|" + begins(_THIRD),
    "assistant_instruction": word(r"(asked|asking|expect|need|remind|request|tell|told|want|wanted) you"),
    "fragment": begins(_OPENERS) + "|" + ends(_DANGLING),
    "conversation_meta": word(rf"(current|earlier|last|new|our|previous|that|the|this) ({_TALK})"),
    "question": r"\?|" + begins("can|could|did|do|does|how|is|should|what|when|where|which|who|whom|whose|why|would"),
    "second_person": word("you|you'd|you'll|you're|you've|your|yours|yourself"),
}
HARD = tuple(FLAGS)[:6]

#: Personal identifiers, the first that fits names the text.
IDENTIFIERS = {
    "email": r"[a-z0-9._%+-]+@[a-z0-9-]+[.][a-z0-9.-]+",
    "phone": r"(^|[^0-9])([+]27|0)[ -]?[1-8][0-9][ -]?[0-9]{3}[ -]?[0-9]{4}($|[^0-9])",
    "national_id": r"(^|[^0-9])[0-9]{13}($|[^0-9])",
    "card": r"(^|[^0-9])[0-9]{15,16}($|[^0-9])",
}

REFERENTIAL = word(r"it|that|this|those|them|he|she|they|the same|above|earlier|again")

_AUX = "am|are|did|do|does|had|has|have|is|was|were"
#: Shapes of a question about what has changed.
CHANGES = (
    r"^what('s| has| have| is)? (changed|different|new)", r"^how (did|has|have) .*(change|changed|develop|developed|evolve|evolved)", rf"^({_AUX}) .*(change|changed|move|moved|replace|replaced|switch|switched)",
    rf"^(how|what|where|which|who|why|{_AUX}) .*used? to{_Z}", rf"^({_AUX}) .*{_A}still{_Z}", rf"^({_AUX}|what|where|which|who) .*{_A}(any ?more|no longer){_Z}",
    rf"^(how|what|where|which|who) .*{_A}(currently|now|nowadays|these days){_Z}", rf"^(how|what|where|which|who) .*{_A}(before|formerly|originally|previously){_Z}", word(r"(current|latest|most recent|newest) (address|city|employer|job|name|plan|status|version)"),
    word(r"(changes|evolution|history|updates) (in|of|to)"), word("changed (her|his|my|our|their) mind"), rf"^({_AUX}) .*{_A}(already|updated|yet){_Z}", rf"^(since when|when) .*{_A}(change|changed|start|started|stop|stopped|switch|switched){_Z}",
)
CHANGE = "|".join(CHANGES)

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_UNITS = "day|week|month|year"
# Weights of the two routing scores, and the score from which a question is routed.
#: (weight, pattern); months count .25 and .10 for each further one, two at most.
TEMPORAL = (
    (0.20, word("|".join(_WEEKDAYS))),
    (0.50, rf"(what|which|who) .*{_A}(earlier|earliest|first|last|later|latest){_Z}|{_A}(came|did|happened|was|were) .*{_A}(after|before){_Z}"),
    (0.25, word(rf"ago|earlier|lately|later|recently|today|tomorrow|tonight|yesterday|(last|next|past|this) (weekend|{_UNITS})")),
    (0.45, word(rf"([0-9]+|a couple of|a few|one|two|three|four|five|six|seven|eight|nine|ten|several) (hour|{_UNITS})s?")),
    (0.60, rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|(^|[^0-9])[0-9]{{1,2}}/[0-9]{{1,2}}(/[0-9]{{2,4}})?($|[^0-9])|{_A}({'|'.join(_MONTHS)}) [0-9]{{1,2}}(st|nd|rd|th)?{_Z}"),
    (0.55, r"(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])"),
    (0.50, word(rf"how (long|old)|how many ({_UNITS})s|since when|what (date|day|month|time|year)|what happened|when") + rf"|{_A}between ({'|'.join(_MONTHS)}) and ({'|'.join(_MONTHS)}){_Z}"),
    (0.30, rf"^(how|what|where|which|who) (did|had|was|were){_Z}|{_A}did (i|we){_Z}"),
)
MONTH_WEIGHTS = (0.25, 0.10)
# Words and phrases of the three classes, with the weight of each hit; two hits of a class count at most.
HOP_WORDS = {
    "reporting": (0.25, (
        "said", "says", "say", "told", "tell", "mentioned", "mentions", "discussed", "discuss", "agreed", "agree", "explained", "explain", "wrote", "write", "sent", "send", "asked", "ask",
        "recommended", "recommend", "suggested", "suggest", "claimed", "claim", "stated", "state", "replied", "reply", "messaged", "talked about", "talk about", "brought up", "raised",
    )),
    "comparison": (0.25, ("compare", "compared", "comparison", "versus", "vs", "different", "differ", "better than", "worse than", "how does", "how do", "which is", "which one")),
    "chain": (0.20, ("and then", "after that", "related to", "connected", "both", "in common", "link", "links", "involves", "involve", "ties to")),
}
# Fixed values: (weight, pattern) of what the other one said; the topic counts only beside a word of a class.
YOU_SAID = (0.30, word("you (said|told|wrote|mentioned|agreed|suggested|recommended|advised|claimed|explained|sent)"))
TOPIC = (0.35, word("(about|regarding)"))
#: On the text as written: names beside a word of a class, and two names joined by "and".
NAME_WEIGHT, NAME_PAIR = 0.30, (0.30, r"[A-Z][a-z]+ and [A-Z][a-z]+")
#: A capitalised word behind one that ends in a small letter, a figure or a comma: no sentence begins there.
NAME = "[a-z0-9,] +([A-Z][A-Za-z]+)"
ROUTE_FROM = 0.50
QUESTION = r"\?|" + begins(rf"{_AUX}|can|could|how|should|what|when|where|which|who|whom|whose|why|will|would")

_REST = r"([^.!?;]+)"
#: Passing states, which say nothing of who somebody is.
TRANSIENT = rf"(^|[^a-z'])i('m| am) (an? )?(bit |little |now |really |so |very )*({_TRIVIAL}|able|about|afraid|going|glad|happy|sorry|trying|waiting)"
_ROLES = "aunt|boss|brother|cousin|daughter|father|friend|husband|manager|mother|neighbour|partner|sister|son|uncle|wife"
# Verbs of liking and adverbs of habit.
_LIKING, _HABIT = "prefer|like|love|hate|enjoy", "always|never|usually|typically|generally|rarely|often"
#: Ordered rules of fact classification: name, category, pattern with the detail in its last group, what a text must not match.
FACTS = (
    ("relationship", "relationship", rf"my ({_ROLES}) is {_REST}", None),
    ("switch", "event", rf"i (?:changed|moved|switched) from {_REST}", None),
    ("attribute", "personal_fact", rf"my favou?rite {_REST}", None),
    ("work", "personal_fact", rf"i work (?:as|at|for|in) {_REST}", None),
    ("location", "personal_fact", rf"i (?:live|am based|grew up) in {_REST}", None),
    ("use", "personal_fact", rf"i (?:have|own|use) {_REST}", None),
    ("my_is", "personal_fact", rf"my [a-z]+ (?:is|are) {_REST}", None),
    ("preference", "preference", rf"i (?:{_LIKING}) {_REST}", None),
    ("habit", "preference", rf"i (?:{_HABIT}) {_REST}", None),
    ("goal", "goal", rf"i (?:hope|intend|plan|want) to {_REST}", None),
    ("insight", "insight", rf"i (?:discovered|learned|noticed|realized) that {_REST}", None),
    ("event", "event", rf"i (?:attended|finished|met|visited) {_REST}", None),
    ("ongoing", "context_note", rf"i(?:'m| am) (?:building|learning|reading|studying|working on|writing) {_REST}", None),
    ("identity", "personal_fact", rf"i(?:'m| am) an? {_REST}", TRANSIENT),
)
#: How a fact is worded, by its rule.
WORDING = {"relationship": "user's close person: ", "switch": "user switched from ", "attribute": "user's favourite ", "work": "user works for ", "location": "user lives in ", "use": "user has ", "my_is": "of user's own: ", "preference": "user likes or dislikes ", "habit": "user's habit: ", "goal": "user wants to ", "insight": "user learned that ", "event": "user took part in ", "ongoing": "user is busy with ", "identity": "user is a "}
#: Relations (name, pattern, type of the target), all with the user as source; the target is the last group.
RELATIONS = (
    ("lives_in", rf"i (?:live|am based|grew up) in {_REST}", "place"), ("works_for", rf"i work (?:at|for) {_REST}", "organization"), ("works_as", rf"i work as {_REST}", "role"),
    ("uses", rf"i use {_REST}", "item"), ("owns", rf"i (?:have|own) {_REST}", "item"), ("prefers", rf"i prefer {_REST}", "concept"), ("prefers_over", rf"i prefer .+ (?:over|to) {_REST}", "concept"),
    ("switched_from", r"i (?:changed|moved|switched) from (.+) to .+", "concept"), ("switched_to", rf"i (?:changed|moved|switched) from .+ to {_REST}", "concept"),
    ("has_goal", rf"i (?:hope|intend|plan|want) to {_REST}", "goal"), ("took_part_in", rf"i (?:attended|visited) {_REST}", "event"), ("met", rf"i met {_REST}", "person"), ("learned", rf"i (?:discovered|learned|noticed|realized) that {_REST}", "concept"),
    ("works_on", rf"i(?:'m| am) (?:building|learning|reading|studying|working on|writing) {_REST}", "concept"), ("married_to", rf"(?:i(?:'m| am) married to|my (?:husband|wife) is) {_REST}", "person"), ("is_a", rf"i(?:'m| am) an? {_REST}", "role"),
    *((f"has_{r}", rf"my {r} is {_REST}", "person") for r in _ROLES.split("|")),
)
#: Endings of names that tell their type, whatever the relation.
TYPE_ENDINGS = (("organization", r" (bank|club|company|corp|group|inc|ltd|school|trading|university)$"), ("person", r"^(customer|supplier)#[0-9]+$"), ("place", r" (city|market|river|street)$"))
DURABLE = ("personal_fact", "preference", "relationship", "insight")
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
# Number words.
NUMBERS = {"a": 1, "an": 1, "one": 1, "couple": 2, "two": 2, "few": 3, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
#: Tokens of a date phrase: fractions, words, and the marks that part phrases.
DATE_TOKEN = "[0-9]+[.][0-9]+|[a-z0-9]+('[a-z]+)?|[.,!?;:]"
#: A text without any of these holds no date phrase.
DATE_ANCHORS = ("ago", "last", "past", "previous", "yesterday", "valentine", *(f"on {m}" for m in _MONTHS))
#: What a token is, and its value: months from 1, weekdays from Monday as 0, days of a unit, numbers.
LEXICON = {
    **{m: ("month", i) for i, m in enumerate(_MONTHS, 1)}, **{w: ("weekday", i) for i, w in enumerate(_WEEKDAYS)},
    **{u + s: ("unit", n) for u, n in UNIT_DAYS.items() for s in ("", "s")}, **{w: ("number", n) for w, n in NUMBERS.items()},
}
# How far back "N units ago" may lead; the feast that has a date of its own.
MOST_AGO, FEAST, FEAST_DAY = 3 * 366, "^valentine'?s?$", (2, 14)


def low(text: str | Column = "content") -> Column:
    # a run that is one space stays as it is
    return F.lower(F.trim(F.regexp_replace(text, r"[ ]\s+|[\t\n\x0B\f\r]\s*", " ")))


def flags(text: Column, category: Column | None = None, among: tuple[str, ...] = tuple(FLAGS)) -> Column:
    """Sorted names of the quality flags that a text has, of those ``among`` them (and, with a category, ``short_lived``)."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    # a bracket that is never closed is junk as well
    names = [F.when(found(text, p) | (count("(") > count(")") if n == "junk" else F.lit(False)), F.lit(n)) for n, p in FLAGS.items() if n in among]
    if category is not None:
        names.append(F.when(category.isin("context_note", "event"), F.lit("short_lived")))
    return F.array_sort(F.array_compact(F.array(*names)))


def hard(text: Column) -> Column:
    """Whether a text, as ``low`` makes it, has any of the flags ``HARD``: all words in one pass, beginnings and ends apart."""
    parts = list(dict.fromkeys(p for n in HARD for p in _cut(FLAGS[n])))
    words = "|".join(p[len(_A) : -len(_Z)] for p in parts if p.startswith(_A) and p.endswith(_Z))
    # the one long beginning is a fragment in any case; the others, and words and marks at the end, are short
    heads = [p for p in parts if p.startswith("^") and "+" not in p]
    tails = [p for p in parts if p.endswith("$") and not p.startswith("^")]
    opened = F.contains(text, F.lit("(")) & (F.length(F.replace(text, F.lit("("), F.lit(""))) < F.length(F.replace(text, F.lit(")"), F.lit(""))))
    return F.left(text, F.lit(64)).rlike("|".join(heads)) | found(F.right(text, F.lit(16)), "|".join(tails)) | opened | found(text, word(words))


def identifier(text: Column) -> Column:
    has = lambda n, p: F.contains(text, F.lit("@")) & text.rlike(p) if n == "email" else found(text, p)
    return F.coalesce(*(F.when(has(n, p), F.lit(n)) for n, p in IDENTIFIERS.items()))


def _words(text: Column, words: tuple) -> Column:
    """Those of the words and phrases that a text has, each once; none may be the beginning of another's words."""
    some = "|".join(words)
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=[{_firsts(some)}])(?<![a-z0-9'])(?=({some})(?![a-z0-9']))"), F.lit(1)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is made once a row: a one-element array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(*terms: Column) -> Column:
    return F.round(F.least(F.lit(1.0), sum(terms, F.lit(0.0))), 6)


def temporal_score(text: Column) -> Column:
    calendar = _bound(F.size(_words(text, _MONTHS)), lambda n: F.when(n > 0, MONTH_WEIGHTS[0] + MONTH_WEIGHTS[1] * F.least(n - 1, F.lit(2))).otherwise(0.0))
    return _total(calendar, *(F.when(found(text, p), F.lit(w)).otherwise(0.0) for w, p in TEMPORAL))


def names(text: Column) -> Column:
    """Capitalised words inside the sentences of a text as written, but calendar words."""
    return F.filter(F.regexp_extract_all(text, F.lit(NAME), F.lit(1)), lambda w: ~F.lower(w).isin(*_MONTHS, *_WEEKDAYS))


def multihop_score(text: Column, written: Column) -> Column:
    every = tuple(w for _, words in HOP_WORDS.values() for w in words)

    def score(had: Column) -> Column:
        also = lambda c, w: F.when((F.size(had) > 0) & c, F.lit(w)).otherwise(0.0)
        return _total(
            *(w * F.least(F.size(F.array_intersect(had, F.array(*map(F.lit, words)))), F.lit(2)) for w, words in HOP_WORDS.values()), F.when(found(text, YOU_SAID[1]), F.lit(YOU_SAID[0])).otherwise(0.0),
            also(F.size(names(written)) > 0, NAME_WEIGHT), also(found(text, TOPIC[1]), TOPIC[0]), also(written.rlike(NAME_PAIR[1]), NAME_PAIR[0]),
        )

    return _bound(_words(text, every), score)


def routed(text: Column, written: Column) -> Column:
    return found(text, QUESTION) & ((temporal_score(text) >= ROUTE_FROM) | (multihop_score(text, written) >= ROUTE_FROM))


def sentences(text: Column, most: int | None = 25, least: int = 15) -> Column:
    """A text's sentences of ``least`` characters or more, among its first ``most`` or all."""
    marked = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"([.!?]) ", "$1\x01")
    every = F.split(marked, "\x01")
    return F.filter(F.slice(every, 1, most) if most else every, lambda s: F.length(s) >= least)


def last_group(pattern: str) -> int:
    """Number of the last capturing group of a pattern."""
    return sum(c == "(" and pattern[i - 1 : i] != "\\" and pattern[i + 1 : i + 2] != "?" for i, c in enumerate(pattern))


def fact(text: Column) -> Column:
    """struct(rule, category, detail) of the first rule that fits, else null."""
    fits = lambda p, block: text.rlike(_quick(_A + p)) & (~text.rlike(block) if block else F.lit(True))
    return F.coalesce(*(F.when(fits(p, block), F.struct(F.lit(n).alias("rule"), F.lit(c).alias("category"), F.trim(F.regexp_extract(text, p, last_group(p))).alias("detail"))) for n, c, p, block in FACTS))


def facts(text: Column) -> Column:
    """The fact as an array of one struct or none, for ``inline``: behind a generator nothing makes it again for each use."""
    return F.array_compact(F.transform(F.array(text), fact))


def kept(content: Column, category: Column) -> Column:
    """array of one struct(flags) of a text to queue, none where it is junk; for ``inline``."""
    found = F.transform(F.array(low(content)), lambda v: F.struct(flags(v, category).alias("flags")))
    return F.filter(found, lambda s: ~F.array_contains(s["flags"], "junk"))


def worded(rule: Column, detail: Column) -> Column:
    """The content of a fact."""
    return F.concat(F.coalesce(*(F.when(rule == n, F.lit(w)) for n, w in WORDING.items())), detail)


def relations(text: Column) -> Column:
    """array of struct(relation, target, type): every relation a text states."""

    def one(n: str, p: str, kind: str) -> Column:
        target = entity(F.regexp_extract(text, p, last_group(p)))
        fits = text.rlike(_quick(_A + p)) & (~text.rlike(TRANSIENT) if n == "is_a" else F.lit(True))
        return F.when(fits, _bound(target, lambda e: F.struct(F.lit(n).alias("relation"), e.alias("target"), entity_type(e, kind).alias("type"))))

    return F.array_compact(F.array(*(one(*r) for r in RELATIONS)))


def entity_type(name: Column, usual: str) -> Column:
    """The type that a name's ending tells, else the relation's."""
    return F.coalesce(*(F.when(name.rlike(p), F.lit(k)) for k, p in TYPE_ENDINGS), F.lit(usual))


def slug(label: Column) -> Column:
    """A relation's name of letters, digits and underscores."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_|_$", ""), F.lit("")), F.lit("related_to"))


def entity(text: Column) -> Column:
    """A name without article, edge punctuation and trailing time words, at most 100 characters."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    t = F.regexp_replace(t, r"^[^a-z0-9]+|[^a-z0-9#]+$", "")
    t = F.regexp_replace(t, r"^(the|a|an|my) ", "")
    return F.substring(F.regexp_replace(t, r" (now|today|currently|lately|anymore)$", ""), 1, 100)


#: Names that name nothing, and the shape of a clause that is no name.
NO_ENTITY = ("anything", "everything", "it", "nothing", "someone", "something", "stuff", "that", "thing", "things", "this", "user")
CLAUSE = r"^(he|i|it|she|they|we|you) | (am|are|is|was|were) "


def entity_fault(name: Column) -> Column:
    """Why a name is no entity, or null."""
    return (
        F.when(F.length(name) < 3, "short").when(F.length(name) >= 80, "long").when(F.size(F.split(name, " ")) > 6, "words")
        .when(name.isin(*NO_ENTITY), "stop word").when(name.rlike(CLAUSE), "clause")
    )


def entity_valid(name: Column) -> Column:
    return entity_fault(name).isNull()


def _cases(value: Column, table: dict[str, int]) -> Column:
    return F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in table.items()))


def _day_of(year: Column, month: Column, day: Column) -> Column:
    """Days since the epoch of a date, null where there is none."""
    return F.unix_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")).try_cast("date"))


UNTIL = r"(?:by|until) ([0-9]{1,2}) (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*( [0-9]{4})?"
LASTS = r"(?:for|next) ([0-9]{1,3}) (day|week|month|year)"


def expiry_days(text: Column, category: Column, ttl: dict[str, int], today: int, fallback: int = 90) -> Column:
    """Days a fact should live: none for durable categories, else "for N units", "until D Mon [YYYY]", the category's, the fallback."""
    days = F.regexp_extract(text, LASTS, 1).try_cast("int") * _cases(F.regexp_extract(text, LASTS, 2), UNIT_DAYS)
    month = _cases(F.regexp_extract(text, UNTIL, 2), {m[:3]: i for i, m in enumerate(_MONTHS, 1)})
    year = F.coalesce(F.trim(F.regexp_extract(text, UNTIL, 3)).try_cast("int"), F.year(F.date_from_unix_date(F.lit(today))))
    fixed = _day_of(year, month, F.regexp_extract(text, UNTIL, 1).try_cast("int")) - today
    own = F.coalesce(*(F.when(category == c, F.lit(d)) for c, d in ttl.items()), F.lit(fallback))
    return F.when(~category.isin(*DURABLE), F.coalesce(F.when(days > 0, days), fixed, own))


def resolved_day(text: Column, day: Column) -> Column:
    """Days since the epoch that a phrase points to from ``day``, null without one.

    The text becomes tokens.  An anchor ("ago", "last", "yesterday", "weekend", "on", the feast) looks at its neighbours,
    for which alone kind and value are looked up in ``LEXICON``, and gives a reading (rank, place, day); the least
    reading counts.  A date without a year is the latest one not after ``day``; one that does not exist (rank 1) still
    counts, as null; a weekday "ago" is the last one up to that day; a number that is none gives no reading.
    """
    lexicon = F.create_map(*(c for w, (k, v) in LEXICON.items() for c in (F.lit(w), F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")))))

    def read(words: Column) -> Column:
        year, weekday = F.year(F.date_from_unix_date(day)), F.pmod(day + 3, F.lit(7))

        def past(month: Column, d: Column) -> Column:
            this = _day_of(year, month, d)
            return F.when(this > day, _day_of(year - 1, month, d)).otherwise(this)

        def at(seen: Column) -> Column:
            t, i = F.get(seen["near"], F.lit(back_to)), seen["at"]
            near = lambda n: F.get(seen["near"], F.lit(back_to + n))
            kind, value = lambda n: F.get(seen["known"], F.lit(back_to + n))["kind"], lambda n: F.get(seen["known"], F.lit(back_to + n))["value"]
            found = lambda rank, d: F.struct(F.lit(rank).alias("rank"), i.alias("at"), d.cast("int").alias("day"))
            of_month = F.regexp_extract(near(2), "^([0-9]{1,2})(st|nd|rd|th)?$", 1)
            span = F.when(value(-2) <= MOST_AGO, value(-2) * value(-1))
            onto = day - value(-2) * value(-1)
            back = F.pmod(weekday - value(1), F.lit(7))
            ago = F.when((kind(-3) == "weekday") & (near(-4) == "the") & value(-1).isin(UNIT_DAYS["week"], UNIT_DAYS["month"]), found(6, onto - F.pmod(onto + 3 - value(-3), F.lit(7)))).when(span.isNotNull(), found(7, day - span))
            return (
                F.when((t == "on") & (kind(1) == "month") & (of_month != ""), found(1, past(value(1), of_month.try_cast("int"))))
                .when(t.rlike(FEAST) & (near(1) == "day"), found(2, past(*map(F.lit, FEAST_DAY))))
                .when(t == "yesterday", F.when((near(-3) == "the") & (near(-2) == "day") & (near(-1) == "before"), found(3, day - 2)).otherwise(found(4, day - 1)))
                .when((t == "weekend") & near(-1).isin("past", "previous", "last"), found(5, day - F.pmod(weekday + 1, F.lit(7))))
                .when((t == "ago") & (kind(-1) == "unit") & (kind(-2) == "number"), ago)
                .when((t == "last") & (kind(1) == "weekday"), found(8, day - F.when(back == 0, 7).otherwise(back)))
                .when((t == "last") & near(1).isin("week", "month", "year"), found(9, day - value(1)))
            )

        anchor = lambda w, i: w.isin("yesterday", "weekend", "ago", "last") | F.startswith(w, F.lit("valentine")) | ((w == "on") & F.get(words, i + 1).isin(*_MONTHS))
        places = F.array_compact(F.transform(words, lambda w, i: F.when(anchor(w, i), i)))
        seen = F.transform(places, lambda i: F.struct(i.alias("at"), F.transform(F.sequence(F.lit(-back_to), F.lit(2)), lambda n: F.get(words, i + n)).alias("near")))
        seen = F.transform(seen, lambda b: F.struct(b["at"].alias("at"), b["near"].alias("near"), F.transform(b["near"], lambda v: F.coalesce(F.try_element_at(lexicon, v), number(v))).alias("known")))
        return F.array_min(F.array_compact(F.transform(seen, at)))["day"]

    back_to = 4  # tokens that a reading looks at before its anchor
    number = lambda w: F.when(w.rlike("^[0-9]{1,9}$"), F.struct(F.lit("number").alias("kind"), w.cast("int").alias("value")))
    # a one-element array binds the tokens, so that they are made once a text
    tokens = F.array(F.regexp_extract_all(text, F.lit(DATE_TOKEN), F.lit(0)))
    some = reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in DATE_ANCHORS))
    return F.when(some, F.get(F.transform(tokens, read), F.lit(0)))
