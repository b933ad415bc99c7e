"""English word roots by the published Porter2 (Snowball) rules, as one Catalyst expression.

Regions are numbers: R1 begins after the first consonant that follows a vowel, R2 is the same within R1, and a suffix lies in a region if
it begins no earlier. A step takes the longest suffix of its list that the word has and acts if its condition holds. Each step binds the
word once, so that the expression does not grow with the number of uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed values of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
           "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
           "bias": "bias", "andes": "andes"}
FINAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
REGION = "^(?:gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])"
SECOND_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
VOWEL = "[aeiouy]"
#: Ends in a short syllable.
SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLE = "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
#: suffix, what takes its place, what must stand before it; all in R1.
SECOND_STEP = [("ization", "ize", ""), ("ational", "ate", ""), ("fulness", "ful", ""), ("ousness", "ous", ""), ("iveness", "ive", ""),
               ("tional", "tion", ""), ("biliti", "ble", ""), ("lessli", "less", ""), ("entli", "ent", ""), ("ation", "ate", ""), ("alism", "al", ""),
               ("aliti", "al", ""), ("ousli", "ous", ""), ("iviti", "ive", ""), ("fulli", "ful", ""), ("enci", "ence", ""), ("anci", "ance", ""),
               ("abli", "able", ""), ("izer", "ize", ""), ("ator", "ate", ""), ("alli", "al", ""), ("bli", "ble", ""), ("ogi", "og", "l$"),
               ("li", "", "[cdeghkmnrt]$")]
#: suffix, what takes its place, the region it must lie in.
THIRD_STEP = [("ational", "ate", "r1"), ("tional", "tion", "r1"), ("alize", "al", "r1"), ("icate", "ic", "r1"), ("iciti", "ic", "r1"), ("ative", "", "r2"),
              ("ical", "ic", "r1"), ("ness", "", "r1"), ("ful", "", "r1")]
#: suffixes that go in R2, and what must stand before them.
FOURTH_STEP = [("ement", ""), ("ance", ""), ("ence", ""), ("able", ""), ("ible", ""), ("ment", ""), ("ant", ""), ("ent", ""), ("ism", ""), ("ate", ""),
               ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""), ("ion", "[st]$"), ("al", ""), ("er", ""), ("ic", "")]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _cases(word: Column, cases: list[tuple[Column, Column]]) -> Column:
    """The first case that holds, else the word."""
    rule = F.when(*cases[0])
    for condition, value in cases[1:]:
        rule = rule.when(condition, value)
    return rule.otherwise(word)


def _within(s: Column, region: str, n: int) -> Column:
    return F.length(s["w"]) - n >= s[region]


def _plurals(s: Column) -> Column:
    w = s["w"]
    return _cases(w, [
        (w.endswith("sses"), _cut(w, 2)),
        (w.endswith("ied") | w.endswith("ies"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))),
        (w.endswith("us") | w.endswith("ss"), w),
        (w.endswith("s") & w.rlike(VOWEL + ".+s$"), _cut(w, 1))])


def _participles(s: Column) -> Column:
    w = s["w"]

    def mended(stem: Column) -> Column:
        return _cases(stem, [
            (stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e"))),
            (stem.rlike(DOUBLE), _cut(stem, 1)),
            (stem.rlike(SHORT) & (F.length(stem) <= s["r1"]), F.concat(stem, F.lit("e")))])

    cases = []
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        n = len(suffix)
        if suffix.startswith("ee"):
            cases.append((w.endswith(suffix), F.when(_within(s, "r1", n), _cut(w, n - 2)).otherwise(w)))
        else:
            cases.append((w.endswith(suffix), F.when(_cut(w, n).rlike(VOWEL), _bound(_cut(w, n), mended)).otherwise(w)))
    return _cases(w, cases)


def _last_y(s: Column) -> Column:
    w = s["w"]
    return F.when(w.rlike(".[^aeiouy][yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _replaced(rules: list[tuple[str, str, str, str]]) -> Callable[[Column], Column]:
    """A step of (suffix, what takes its place, region, what must stand before)."""
    def step(s: Column) -> Column:
        w = s["w"]
        cases = []
        for suffix, new, region, before in rules:
            holds = _within(s, region, len(suffix))
            if before:
                holds = holds & _cut(w, len(suffix)).rlike(before)
            stem = _cut(w, len(suffix))
            cases.append((w.endswith(suffix), F.when(holds, F.concat(stem, F.lit(new)) if new else stem).otherwise(w)))
        return _cases(w, cases)

    return step


def _last_letter(s: Column) -> Column:
    w = s["w"]
    stem = _cut(w, 1)
    return _cases(w, [
        (w.endswith("e") & (_within(s, "r2", 1) | (_within(s, "r1", 1) & ~stem.rlike(SHORT))), stem),
        (w.endswith("ll") & _within(s, "r2", 1), stem)])


STEPS: list[Callable[[Column], Column]] = [
    _plurals, _participles, _last_y,
    _replaced([(suffix, new, "r1", before) for suffix, new, before in SECOND_STEP]),
    _replaced([(suffix, new, region, "") for suffix, new, region in THIRD_STEP]),
    _replaced([(suffix, "", "r2", before) for suffix, before in FOURTH_STEP]),
    _last_letter]


def _marked(word: Column) -> Column:
    """``y`` as a consonant is ``Y``."""
    return F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")


def _region(word: Column, pattern: str) -> Column:
    return _bound(F.length(F.regexp_extract(word, pattern, 0)), lambda n: F.when(n > 0, n).otherwise(F.length(word)))


def stem(word: Column) -> Column:
    """Root of a lower-case English word; words of one or two letters stay."""
    def started(w: Column) -> Column:
        return _bound(_region(w, REGION), lambda r1: F.struct(
            w.alias("w"), r1.alias("r1"), (r1 + _region(F.substring(w, r1 + 1, F.length(w)), SECOND_REGION)).alias("r2"), F.lit(False).alias("over")))

    state = _bound(_marked(word), started)
    for number, step in enumerate(STEPS):
        def applied(s: Column, step=step, number=number) -> Column:
            new = F.when(s["over"], s["w"]).otherwise(step(s))
            over = s["over"] | new.isin(FINAL) if number == 0 else s["over"]
            return F.struct(new.alias("w"), s["r1"].alias("r1"), s["r2"].alias("r2"), over.alias("over"))

        state = _bound(state, _one(applied))
    special = F.create_map(*[F.lit(v) for pair in SPECIAL.items() for v in pair])
    return F.coalesce(special[word], F.when(F.length(word) <= 2, word).otherwise(F.translate(state["w"], "Y", "y")))


def _one(use: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A function of one argument, as Spark's higher-order functions ask for."""
    def call(s: Column) -> Column:
        return use(s)

    return call
