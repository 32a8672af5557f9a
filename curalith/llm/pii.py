"""Personal data by regular expressions, checksums and context words, in SQL functions only.

A kind's matches are cut out of a text by one expression twice: ``split`` gives the text
between them, ``regexp_extract_all`` the matches. Lengths of both, added up, are the places;
the ends of the pieces beside a match are its context.

The expressions match what their plain forms match (see the tests) but never search a run
of characters twice: a match begins where a run begins or where the last match ended, and
repetitions do not give back. So time is linear, and no text overflows Java's stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalith.llm.common import set_aside

#: Zeros, then what they lead; at least one digit in all.
_OCTET = "(?=[0-9])0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
#: Characters beside a match that are looked at for context words.
CONTEXT = 48
#: Spans of the kinds that the method adds count from this score on.
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    """Name, expression, what a text must hold for a match, score of a confirmed match and its context words."""

    name: str
    pattern: str
    needs: str
    score: float
    words: str
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "", 0.8, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, "card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|call|tel|mobil|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.9, "iban|bank|account|konto|cuenta|compte", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, r"ssn|social|security|tax", False),
)


def _mod_97(iban: Column) -> Column:
    """Whether an account number (blanks removed) leaves 1 when divided by 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    codes = F.transform(F.split(moved, ""), lambda c: F.ascii(c))
    value = F.aggregate(codes, F.lit(0), lambda acc, c: F.when(c == 0, acc).when(c < 65, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97))
    return value == 1


def _confirmed(kind: str, body: Column) -> Column:
    if kind == "ip":
        return body.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.translate(body, " -", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.translate(body, "+ ().-", "")).between(9, 15)
    if kind == "iban":
        return _mod_97(F.translate(body, " ", ""))
    return F.lit(True)


def _spans(kind: Kind, number: int, gaps: Column, found: Column) -> Column:
    """Confirmed matches as (start, kind number, end, score); the places in code points."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,kind:int,end:long,score:double>>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        gap, body, after = F.element_at(gaps, k), F.element_at(found, k), F.element_at(gaps, k + 1)
        begin = acc["at"] + F.length(gap)
        end = begin + F.length(body)
        near = F.lower(F.concat(F.right(gap, F.lit(CONTEXT)), F.lit(" "), F.left(after, F.lit(CONTEXT))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.words), F.lit(0.3)).otherwise(F.lit(0.0))
        span = F.struct(begin.cast("long").alias("start"), F.lit(number).alias("kind"), end.cast("long").alias("end"), F.least(score, F.lit(1.0)).alias("score"))
        good = _confirmed(kind.name, body) if kind.base else _confirmed(kind.name, body) & (score >= THRESHOLD)
        return F.struct(end.cast("long").alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.sequence(F.lit(1), F.size(found)), start, step)
    return F.when(F.size(found) > 0, done["out"]).otherwise(start["out"])


def found(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_pii``: the spans of all kinds in order of start, then kind.

    Null text is empty and has none. All other columns stay; one named ``_pii`` is replaced.
    """
    held = docs.drop("_pii").withColumn("_pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    held = held.withColumn("_pii_digit", F.col("_pii_text").rlike("[0-9]"))
    cut, spans = {}, []
    for k, kind in enumerate(KINDS):
        may = F.contains(F.col("_pii_text"), F.lit(kind.needs)) if kind.needs else F.lit(True)
        may = may if kind.name == "email" else may & F.col("_pii_digit")
        empty = F.array().cast("array<string>")
        cut[f"_pii_gaps{k}"] = F.when(may, F.split("_pii_text", kind.pattern, -1)).otherwise(empty)
        cut[f"_pii_found{k}"] = F.when(may, F.regexp_extract_all("_pii_text", F.lit(kind.pattern), 0)).otherwise(empty)
        spans.append(_spans(kind, k, F.col(f"_pii_gaps{k}"), F.col(f"_pii_found{k}")))
    held = held.withColumns(cut)
    ordered = F.array_sort(F.concat(*spans))
    return held.withColumn("_pii", ordered).drop("_pii_text", "_pii_digit", *cut)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    parts = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def _count(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, and all spans."""
    n_base = sum(k.base for k in KINDS)
    spans = F.col("_pii")
    counts = [_count(spans, i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    base = _joined(F.filter(spans, lambda s: s["kind"] < n_base))
    rows = found(docs.select("doc_id", "text")).select("doc_id", "_pii")
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.transform(spans, lambda s: s["score"]).alias("scores"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans are one.

    Columns stay as they are; a text without spans, or null, is unchanged. ``n_chars``, where
    the input has it, is counted anew for changed texts.
    """
    names_kept = docs.columns
    docs, columns = set_aside(docs, ["_pii", "_pii_text", "_pii_digit", "_redacted", *(f"_pii_{x}{k}" for k in range(len(KINDS)) for x in ("gaps", "found"))])
    text = F.col("text").cast("string")
    names = F.array(*(F.lit(f"[{k.name.upper()}]") for k in KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        before = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        longer = F.concat(acc["out"], before, F.element_at(names, s["kind"] + 1))
        return F.struct(F.when(apart, longer).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("_pii", start, step)
    new = F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))
    out = found(docs).withColumn("_redacted", F.when(F.size("_pii") > 0, new).otherwise(F.col("text")))
    counted = F.when(F.size("_pii") > 0, F.length("_redacted").cast(dict(docs.dtypes).get("n_chars", "long")))
    values = {"text": F.col("_redacted"), "n_chars": F.coalesce(counted, F.col("n_chars")) if "n_chars" in names_kept else None}
    return out.select(*(values[c].alias(c) if values.get(c) is not None else same for c, same in zip(names_kept, columns)))
