"""Personal data in text, found and masked with built-in functions only.

Patterns propose spans, checks confirm them (octets of an address, Luhn, digits of a phone number, mod-97), and words
just before a span raise its score. The four base kinds stay whatever their score; the added kinds need MIN_SCORE.

Spark has no function for the places of all matches, so they are rebuilt: ``split`` gives the gaps between the very
matches that ``regexp_extract_all`` gives, and the running sum of both lengths gives the offsets, in code points. The
patterns never give back what they took (possessive quantifiers), so a text costs time in proportion to its length and
no recursion, and ``\\G`` or a look-behind keeps a search from starting again inside a run that has failed. Account codes
are proposed by a look-ahead, so every place where one may begin is tried, and end where the length of their country says.
Context words are looked for between a span and the match of the same kind before it, at most CONTEXT code points back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

MIN_SCORE = 0.5
#: Code points before a span that are searched for context words.
CONTEXT = 40


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code without spaces leaves 1 modulo 97 (first four characters last, A is 10)."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _octets(m: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


#: Lengths of account codes by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV YE", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Codes of other countries go on as far as they can, to 34 characters, and end before what isn't a letter or digit.
_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_OTHER = rf"(?!{'|'.join(c.replace(' ', '|') for c in IBAN_LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_KNOWN}|{_OTHER})(?![A-Za-z0-9])))"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    words: str  # a pattern of context words
    more: float  # what they add to the score
    need: str  # a character or pattern that a text must hold for the search to be worth while
    base: bool = True
    ahead: bool = False  # the pattern matches the empty string at a start; its first group is the span


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, "mail|contact|write", 0.1, "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+", _octets, 0.6, "ip|address|host|server", 0.3, "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: F.length(_digits(m)).between(12, 19) & luhn(_digits(m)), 0.8, "card|visa|credit|pay", 0.2, ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|call|tel|mobile|fax", 0.3, "+"),
    Kind("iban", IBAN, lambda m: mod97(F.regexp_replace(m, " ", "")), 0.9, "iban|account|bank", 0.1, "", False, True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.3, "ssn|social security|social insurance", 0.5, "-", False),
)
SPAN = "array<struct<start:int,rank:int,stop:int,score:double>>"


#: Code points of a block of a text; a piece of the text is cut from the blocks that it lies in, and not from the text's start.
BLOCK = 512


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running sums, or other joins, of an array: in each round an item takes in the one that lies twice as far back as in the
    round before. (A fold that appends to a list would copy the list for each item.)"""

    def rounds(v: Column) -> Column:
        back = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda p: p < F.size(v))
        return F.aggregate(back, v, lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, join(x, F.get(acc, i - p))).otherwise(x)))

    return _with(values, rounds)


def _apart(spans: Column) -> Column:
    """Of spans by start, those that begin at or after the end of the last one kept. Runs of overlapping spans are short (a span
    is) and are folded each for itself."""

    def cut(v: Column) -> Column:
        reach, n = _running(F.transform(v, lambda s: s["stop"]), F.greatest), F.size(v)
        begins = _with(reach, lambda r: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(v, i)["start"] >= F.get(r, i - 1), F.lit(True))))
        runs = _with(begins, lambda k: F.transform(k, lambda i, j: F.slice(v, i + 1, F.coalesce(F.get(k, j + 1), n) - i)))
        kept = lambda run: F.aggregate(run, F.array().cast(SPAN), lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= F.element_at(acc, -1)["stop"]), F.concat(acc, F.array(s))).otherwise(acc))
        return F.flatten(F.transform(runs, kept))

    return _with(spans, lambda v: F.when(F.size(v) > 1, cut(v)).otherwise(v))


def _spans(text: Column, matches: Column, rank: int) -> Column:
    kind, none = KINDS[rank], F.array().cast(SPAN)

    def found(v: Column) -> Column:
        gap = lambda i: F.get(v["gaps"], i)
        own = lambda m: F.lit(0) if kind.ahead else F.length(m)
        ends = _running(F.transform(v["matches"], lambda m, i: F.length(gap(i)) + own(m)), lambda x, y: x + y)

        def span(m: Column, i: Column, ends: Column) -> Column:
            start = F.get(ends, i) - (F.lit(1) if kind.ahead else own(m))
            near = F.lower(F.right(gap(i), F.lit(CONTEXT))).rlike(rf"(?:^|[^a-z])(?:{kind.words})")
            score = F.lit(kind.score) + F.when(near, kind.more).otherwise(0.0)
            good = kind.valid(m) if kind.base else kind.valid(m) & (score >= MIN_SCORE)
            return F.when(good, F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("stop"), score.alias("score")))

        return F.array_compact(_with(ends, lambda e: F.transform(v["matches"], lambda m, i: span(m, i, e)))).cast(SPAN)

    # an empty match at the very start would part nothing, so a line end goes before the text
    gaps = F.split(F.concat(F.lit("\n"), text) if kind.ahead else text, kind.pattern, -1)
    spans = _with(F.struct(gaps.alias("gaps"), matches.alias("matches")), found)
    return F.when(F.size(matches) > 0, _apart(spans) if kind.ahead else spans).otherwise(none)


def find_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with an array of (start, rank in KINDS, stop, score) of every whole text, by start and then rank.

    Offsets are in code points, stop is exclusive. A null or empty text has an empty array; rows are neither joined nor
    moved, so repeated rows and an empty table are nothing special, and other columns are left alone. The work grows with the
    text and its matches, however many these are.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    found, names = docs, [free_name(docs, f"_m{k}") for k in range(len(KINDS))]
    for k, kind in enumerate(KINDS):
        matches = F.regexp_extract_all(value, F.lit(kind.pattern), F.lit(int(kind.ahead)))
        if kind.need:
            matches = F.when(F.contains(value, F.lit(kind.need)), matches).otherwise(F.array().cast("array<string>"))
        found = found.withColumn(names[k], matches)
    joined = F.array_sort(F.concat(*(_spans(value, F.col(n), k) for k, n in enumerate(names))))
    return found.withColumn(out, joined).drop(*names)


def span_text(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, name: str) -> Column:
    rank = next(i for i, k in enumerate(KINDS) if k.name == name)
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, replaced by its first kind in square brackets."""
    names = F.array(*(F.lit(f"[{k.name.upper()}]") for k in KINDS))

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """The text from offset a on, before offset b."""
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        at = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
        whole = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        apart = F.concat(F.substring(at(i), a % BLOCK + 1, F.lit(BLOCK)), whole, F.substring(at(j), F.lit(1), b % BLOCK))
        return F.when(i == j, F.substring(at(i), a % BLOCK + 1, b - a)).otherwise(apart)

    def cut(v: Column) -> Column:
        """A span counts if it begins where all spans before it have ended, and the text goes on from there."""
        reach = _running(F.transform(v["spans"], lambda s: s["stop"]), F.greatest)
        with_label = lambda s, at: F.when(s["start"] >= at, F.concat(between(v["blocks"], at, s["start"]), F.element_at(names, s["rank"] + 1)))
        pieces = lambda r: F.transform(v["spans"], lambda s, i: with_label(s, F.coalesce(F.get(r, i - 1), F.lit(0))))
        # no offset is beyond the last block's end, so that ends the text
        return _with(reach, lambda r: F.concat(F.array_join(pieces(r), ""), between(v["blocks"], F.element_at(r, -1), F.size(v["blocks"]) * BLOCK)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _with(F.struct(blocks.alias("blocks"), spans.alias("spans")), cut)).otherwise(text)
