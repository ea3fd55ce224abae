"""Personal data in texts, as SQL expressions: patterns propose, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters on either side in which a context word counts, what it adds, and the least score of a span.
NEARBY, CONTEXT_GAIN, LEAST_SCORE = 40, 0.2, 0.5
#: Characters that hold an IBAN with a space before each of its up to 34 characters, and what follows it.
LONGEST = 68


class Kind(NamedTuple):
    """One kind of personal data.

    ``hint`` must match every text with a span; it spares the others the full search. The patterns use
    possessive loops, which match the same texts and need no stack or backtracking, and start only where a
    run of characters starts or the search goes on (``\\G``), so that long runs cost linear time.
    If a kind has ``wholes``, its pattern matches the starts alone, and a span is the first valid match of
    these patterns there, in at most LONGEST characters.
    """

    name: str
    hint: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    wholes: tuple[str, ...] = ()


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def valid_card(span: Column) -> Column:
    return F.length(digits(span)).between(16, 19) & F.call_function("luhn_check", digits(span))


def valid_iban(span: Column) -> Column:
    """ISO 7064: the first four characters go to the end, letters count from 10, the rest by 97 is 1."""
    plain = F.replace(span, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda rest, c: F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55)
        % 97,
    )
    return F.length(plain).between(15, 34) & (rest == 1)


OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

#: Countries by the length of their IBANs; those of other countries may have any length.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern(size: int) -> str:
    """An IBAN of so many characters from the start of a text, if it is of a country that has or may have such."""
    known = "|".join(" ".join(IBAN_COUNTRIES.values()).split())
    here = "".join(f"{code}|" for code in IBAN_COUNTRIES.get(size, "").split())
    return rf"^(?:{here}(?!{known})[A-Z]{{2}})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{size - 4}}}(?![A-Za-z0-9])"


EMAIL = Kind(
    "email",
    "@",
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    lambda span: F.lit(True),
    0.8,
    r"\b(?:e-?mail|contact|write|address)\b",
)
IP = Kind(
    "ip",
    r"[0-9]\.[0-9]",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    lambda span: span.rlike(OCTETS),
    0.6,
    r"\b(?:ip|host|server|client|address)\b",
)
CARD = Kind(
    "card",
    r"[0-9](?:[\x20-]?[0-9]){15}",
    r"[0-9](?:[\x20-]?+[0-9])++",
    valid_card,
    0.7,
    r"\b(?:card|visa|credit|debit|payment|mastercard)\b",
)
PHONE = Kind(
    "phone",
    r"\+[0-9]",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    lambda span: F.length(digits(span)).between(8, 15),
    0.6,
    r"\b(?:tel|telephone|phone|call|fax|mobile)\b",
)
#: The base kinds keep all confirmed spans; the others are dropped below LEAST_SCORE.
BASE = (EMAIL, IP, CARD, PHONE)
IBAN = Kind(
    "iban",
    r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?+[A-Z0-9]){11})",
    valid_iban,
    0.8,
    r"\b(?:iban|account|bank|transfer)\b",
    tuple(map(iban_pattern, range(15, 35))),
)
SSN = Kind(
    "ssn",
    r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    lambda span: ~span.rlike(r"^(?:000|666|9)|-00-|-0000$"),
    0.4,
    r"\b(?:ssn|social security)\b",
)
KINDS = (*BASE, IBAN, SSN)

#: Code points of a chunk of text, and the most values that are summed up one by one.
CHUNK, SHORT = 1024, 64

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def text_chunks(text: Column) -> Column:
    """The text cut at every CHUNK code points, so that a place in a long text is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def stretch(chunks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive, at most the end of the text) from its chunks."""
    first, last = (F.floor(place / CHUNK).cast("int") for place in (start, end))

    def cut(at: Column) -> Column:
        get = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        # A slice copies the whole array first, so it is left to long stretches.
        many = F.array_join(F.slice(chunks, at["first"] + 1, at["last"] - at["first"] + 1), "")
        whole = F.when(at["last"] - at["first"] <= 1, F.concat(get(at["first"]), get(at["first"] + 1))).otherwise(many)
        begin = at["start"] - at["first"] * CHUNK + 1
        return F.substring(whole, begin.cast("int"), (at["end"] - at["start"]).cast("int"))

    places = {"first": first, "last": last, "start": start, "end": end}
    return bound(F.struct(*[place.alias(name) for name, place in places.items()]), cut)


def running(values: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``first`` and then the result of every ``step`` over the values.

    Appending copies what is there. So it is done in blocks of about the root of the number of values, and once over
    their results: n values take about n to the power 1.5 copies of one number, a fraction of a second for 100,000.
    """
    append = lambda so_far, x: F.concat(so_far, F.array(step(F.element_at(so_far, -1), x)))

    def joined(blocks: Column) -> Column:
        totals = F.transform(
            blocks, lambda block: F.aggregate(F.slice(block, F.lit(2), F.size(block)), F.get(block, F.lit(0)), step)
        )
        before = F.aggregate(totals, F.array(first), append)
        inside = F.zip_with(
            blocks,
            F.slice(before, F.lit(1), F.size(blocks)),
            lambda block, at: F.slice(F.aggregate(block, F.array(at), append), F.lit(2), F.size(block)),
        )
        return F.concat(F.array(first), F.flatten(inside))

    def of(x: Column) -> Column:
        run = F.sqrt(F.size(x)).cast("int")
        starts = F.sequence(F.lit(1), F.size(x), run)
        in_blocks = bound(F.transform(starts, lambda start: F.slice(x, start, run)), joined)
        return F.when(F.size(x) <= SHORT, F.aggregate(x, F.array(first), append)).otherwise(in_blocks)

    return bound(values, of)


def confirmed(kind: Kind) -> Column:
    """Confirmed spans of one kind from its columns of hits and ends and the text's chunks, in order."""
    hits, ends, chunks = (F.col(f"__{name}") for name in (f"hits_{kind.name}", f"ends_{kind.name}", "chunks"))
    def piece(start: Column, end: Column) -> Column:
        return stretch(chunks, F.greatest(start, F.lit(0)), end)

    def whole(hit: Column, start: Column) -> Column:
        """The span that starts where the hit does; null if none is valid."""
        if not kind.wholes:
            return hit
        text = piece(start, start + LONGEST)
        found = F.array(*[F.regexp_extract(text, pattern, 0) for pattern in kind.wholes])
        return F.get(F.filter(found, lambda x: (x != "") & kind.valid(x)), F.lit(0))

    def span(hit: Column, at: Column) -> Column:
        start = F.get(ends, at + 1) - F.length(hit)
        return bound(F.struct(start.alias("start"), hit.alias("hit")), lambda x: bound(whole(x["hit"], x["start"]), partial(of, x)))

    def of(x: Column, found: Column) -> Column:
        return bound(F.struct(x["start"].alias("start"), (x["start"] + F.length(found)).alias("end")), partial(judged, found))

    def judged(found: Column, at: Column) -> Column:
        before, after = piece(at["start"] - NEARBY, at["start"]), piece(at["end"], at["end"] + NEARBY)
        near = F.lower(F.concat(before, F.lit(" "), after)).rlike(kind.context)
        score = F.round(F.lit(kind.score) + F.when(near, CONTEXT_GAIN).otherwise(0.0), 2)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            at["start"].alias("start"),
            at["end"].alias("end"),
            F.when(kind.valid(found), score).alias("score"),
        )

    least = 0.0 if kind in BASE else LEAST_SCORE
    return F.filter(F.transform(hits, span), lambda x: F.coalesce(x["score"] >= least, F.lit(False)))


def personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` in a struct ``row``, with the whole text and its ``spans``.

    Returns ``(row, text, spans)``; a span has kind, start, end (code points, end exclusive)
    and score, ordered by kind as listed, then start. A null text counts as empty and has
    no spans; a null doc_id and columns of any other name pass through in ``row``; repeated
    rows are searched each, and an empty table gives no rows. No shuffle: the gaps between the matches of a
    pattern, split by the same pattern, give all places in one walk through the text. A long text, or one
    with very many hits, takes time about in proportion: places are looked up in chunks of it. Overlapping
    spans of different kinds are all kept; within a kind there are none.
    """
    searched = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    nothing = F.array().cast("array<string>")
    hits = {
        f"__hits_{k.name}": F.when(
            F.contains("text", F.lit(k.hint)) if k.hint == "@" else F.col("text").rlike(k.hint),
            F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)),
        ).otherwise(nothing)
        for k in kinds
    }
    gaps = {
        f"__gaps_{k.name}": F.when(F.size(f"__hits_{k.name}") > 0, F.split("text", k.pattern, -1)).otherwise(nothing)
        for k in kinds
    }

    def ends(kind: Kind) -> Column:
        steps = F.zip_with(
            f"__hits_{kind.name}",
            F.slice(f"__gaps_{kind.name}", F.lit(1), F.size(f"__hits_{kind.name}")),
            lambda hit, gap: (F.length(hit) + F.length(gap)).cast("bigint"),
        )
        return running(steps, F.lit(0).cast("bigint"), lambda so_far, step: so_far + step)

    any_hits = reduce(Column.__or__, [F.size(f"__hits_{k.name}") > 0 for k in kinds])
    chunks = F.when(any_hits, text_chunks(F.col("text"))).otherwise(nothing)
    placed = searched.withColumns(hits).withColumns(gaps)
    placed = placed.withColumns({"__chunks": chunks, **{f"__ends_{k.name}": ends(k) for k in kinds}})
    return placed.select("row", "text", F.concat(*map(confirmed, kinds)).cast(f"array<{SPAN}>").alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kind(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == name)).cast("bigint")


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mark such as ``<EMAIL>`` for each span; of overlapping spans the first one's mark stays."""
    ordered = F.sort_array(
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    )
    # A span joins those before it when it starts before the largest of their ends.
    reached = running(F.transform(ordered, lambda x: x["end"]), F.lit(-1).cast("bigint"), lambda a, b: F.greatest(a, b))
    one = F.struct(ordered.alias("spans"), reached.alias("reached"), text_chunks(text).alias("chunks"))

    def first_of_group(at: Column, x: Column) -> Column:
        return F.get(x["spans"], at)["start"] >= F.get(x["reached"], at)

    def marked(x: Column) -> Column:
        everyone = F.sequence(F.lit(0), F.size(x["spans"]) - 1)
        heads = F.filter(everyone, lambda at: first_of_group(at, x))
        groups = F.transform(
            heads,
            lambda head: F.struct(
                F.get(x["spans"], head).alias("span"),
                # Up to where the spans before this group, and those of the group itself, reach.
                F.greatest(F.get(x["reached"], head), F.lit(0)).alias("before"),
            ),
        )
        parts = F.transform(
            groups,
            lambda g: F.concat(
                stretch(x["chunks"], g["before"], g["span"]["start"]), F.lit("<"), F.upper(g["span"]["kind"]), F.lit(">")
            ),
        )
        rest = stretch(x["chunks"], F.element_at(x["reached"], -1), F.length(text).cast("bigint"))
        return F.concat(F.array_join(parts, ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(F.transform(F.array(one), marked)[0])
