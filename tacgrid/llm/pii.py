"""Personal data, on DataFrame functions alone.

For each kind a regular expression proposes spans, a validator (Luhn, mod 97, ranges, numbers of digits) confirms them,
and words nearby raise or lower the score. Spark tells no positions of matches; they follow from the lengths of the
matches and of the pieces between them, which split() gives for the same expression. The expressions are written so that
nothing is scanned twice: possessive repeats, and starts only where a run begins or the last match ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tacgrid.llm.arrays import let, running_sums
from tacgrid.llm.base import table

SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"
#: Code points looked at on either side of a match, as far as the next match of the kind.
NEAR = 40
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count 10 to 35, the remainder is 1."""
    plain = F.regexp_replace(value, " ", "")
    chars = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")
    code = lambda c: F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(F.length(c) == 0, acc).otherwise((acc * F.when(F.ascii(c) < 58, 10).otherwise(100) + code(c)) % 97)
    return F.length(plain).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)


@dataclass(frozen=True)
class Kind:
    """guard: no match without this string. words, against: expressions that raise or lower the score by 0.2."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    guard: str | None
    score: float
    words: str
    against: str = r"(?!)"
    least: float = 0.0


#: In this order in the result. Spans of the first four stay whatever their score.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True), "@", 0.8, r"(?i)\b(?:e-?mail|contact|write|mailto)"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), ".", 0.6, r"(?i)\b(?:ip|host|server|address|login)\b", r"(?i)\b(?:version|release|section)\b"),
    Kind("card", r"[0-9](?:[ -]?+[0-9]){15,}+", lambda v: F.length(_digits(v)).between(16, 19) & F.call_function("luhn_check", _digits(v)), None, 0.7, r"(?i)\b(?:card|visa|credit|payment|cvv)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(8, 15), "+", 0.6, r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
)
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _mod97, None, 0.8, r"(?i)\b(?:iban|account|bank)\b", least=0.7),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda v: F.lit(True), "-", 0.5, r"(?i)\b(?:ssn|social security|taxpayer)\b", least=0.7),
)


def spans(text: Column, kind: Kind) -> Column:
    """SPAN of the valid matches of one kind, by start. text isn't null."""

    def score(before: Column, after: Column) -> Column:
        near = F.concat(F.right(before, F.lit(NEAR)), F.lit(" \n "), F.left(after, F.lit(NEAR)))
        return F.lit(kind.score) + F.when(near.rlike(kind.words), 0.2).otherwise(0.0) - F.when(near.rlike(kind.against), 0.2).otherwise(0.0)

    def located(matches: Column) -> Column:
        def struct(pieces: Column, sums: Column) -> Column:
            return F.transform(
                matches,
                lambda m, i: F.struct(
                    F.lit(kind.name).alias("kind"),
                    (F.get(sums, i) - F.char_length(m)).alias("start"),
                    F.get(sums, i).alias("end"),
                    m.alias("value"),
                    score(F.get(pieces, i), F.get(pieces, i + 1)).alias("score"),
                ),
            )

        lengths = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(matches)), matches, lambda a, b: F.char_length(a) + F.char_length(b))
        found = let(F.split(text, kind.pattern, -1), lambda p: let(lengths(p), lambda n: let(running_sums(n), lambda s: struct(p, s))))
        return F.filter(found, lambda s: kind.valid(s["value"]) & (s["score"] >= kind.least - 1e-9))

    none = F.from_json(F.lit("[]"), SPAN)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none))
    return F.when(text.contains(kind.guard), found).otherwise(none) if kind.guard else found


def find_pii(docs: DataFrame) -> DataFrame:
    """docs (text, ...) -> all its columns and pii, a list of (kind, start, end, value, score) by kind and start.

    Positions are code points, end exclusive. Null and empty texts have no spans; repeated rows get equal results. Spans
    of different kinds may overlap. A column pii of the input is replaced.
    """
    docs = docs.drop("pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("pii", F.concat(*(spans(text, k) for k in (*BASE, *MORE))))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in BASE]
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(count(k) for k in base),
        F.sha2(said(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        said(F.col("pii")).alias("spans"),
        F.array_max(F.transform("pii", lambda s: F.round(s["score"], 2))).alias("top_score"),
    )
