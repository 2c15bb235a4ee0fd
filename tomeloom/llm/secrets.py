"""Secret scan: strong patterns, and weak parts linked with their complements.

Base spans come from three patterns that stand alone.  The multipart method
adds weak candidates (a login name, a short or unlabelled key, an endpoint),
which mean nothing alone: an interval join over one document's parts keeps a
weak one only if the parts that complete a credential lie within ``scope`` code
points of it.  DataFrame functions only.

Defined cases: null text counts as empty; an empty text has no spans; rows
without an id are left out; repeated rows give repeated results; two rows that
share an id but not the text are scanned apart.  Other columns of the input are
ignored, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import running_sums
from ._base import Scratch, doc_rows, table

# The base kinds in their order, with the least length of what is kept.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the whole runs of 18 and more
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12


@dataclass(frozen=True)
class Kind:
    name: str
    part: str  # id, key or end: what it is of a credential
    weak: bool
    pattern: str
    value_group: int = 0
    value_least: int = 0
    needs: tuple[str, ...] = ()  # what a match must hold besides


KINDS = (
    Kind("assign", "key", False, ASSIGN, 2, ASSIGN_LEAST),
    Kind("access", "id", False, ACCESS),
    Kind("hex", "key", False, HEX),
    Kind("login", "id", True, r"""(?i)\b(user|username|user_?id|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})"""),
    Kind("key", "key", True, r"""(?i)\b(pass|pwd|password|passwd|passphrase|secret|secret_?key|token|auth|credential|private_?key|signature)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""),
    Kind("opaque", "key", True, r"[A-Za-z0-9+/]{24,}={0,2}", needs=("[0-9]", "[A-Z]", "[a-z]")),
    Kind("endpoint", "end", True, r"""(?i)\b(?:https?|ftp|s3|jdbc:[a-z]{2,12}|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:host|server|endpoint|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?"""),
)
SCOPE = 200


def _spans(text: Column, kind_no: int, kind: Kind) -> Column:
    """Array of (start, kind_no, end) of the kind's matches, in code points.

    Matches and the gaps between them alternate, so running lengths give places.
    """
    rx = F.lit(kind.pattern)
    hits = F.regexp_extract_all(text, rx, F.lit(0))
    values = F.regexp_extract_all(text, rx, F.lit(kind.value_group)) if kind.value_least else hits
    found = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), hits.alias("hits"), values.alias("values"))

    def keep(s: Column, h: Column, i: Column) -> Column:
        test = F.length(F.get(s["values"], i)) >= kind.value_least
        for must in kind.needs:
            test = test & h.rlike(must)
        return test

    def placed(s: Column, ends: Column) -> Column:
        every = F.transform(s["hits"], lambda h, i: F.struct((F.get(ends, i) - F.length(h)).alias("start"), F.lit(kind_no).alias("kind"), F.get(ends, i).alias("end"), keep(s, h, i).alias("keep")))
        return F.transform(F.filter(every, lambda x: x["keep"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    # lambda variables hold the matches and the sums: they are computed once, not once a match
    lengths = lambda s: F.transform(s["hits"], lambda h, i: F.length(F.get(s["gaps"], i)) + F.length(h))
    spans = F.transform(F.array(found), lambda s: F.get(F.transform(F.transform(F.array(lengths(s)), running_sums), lambda ends: placed(s, ends)), F.lit(0)))
    return F.when(text.rlike(kind.pattern), F.get(spans, F.lit(0))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan_parts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base and weak spans of each row."""
    spans = [_spans(F.col("text"), i, k) for i, k in enumerate(KINDS)]
    base = F.concat(*[s for s, k in zip(spans, KINDS, strict=True) if not k.weak])
    weak = F.concat(*[s for s, k in zip(spans, KINDS, strict=True) if k.weak])
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), base.alias("base"), weak.alias("weak"))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_key, extra: the weak spans whose complements lie within scope.

    An id or a key needs the other one near; an endpoint needs both.  Cells of
    ``scope`` code points make the interval condition an equi-join, whose semi
    form emits no pairs.
    """
    kinds = F.array(*[F.lit(k.part) for k in KINDS])
    with_weak = parts.where(F.size("weak") > 0).select("doc_id", "text_key", "base", "weak")
    rows = with_weak.select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("s")).select(
        "doc_id", "text_key", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end")
    )
    rows = rows.distinct().withColumn("part", F.get(kinds, F.col("kind")))
    n_base = sum(not k.weak for k in KINDS)
    near = rows.select("doc_id", "text_key", "part", F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("cell"))
    weak = rows.where(F.col("kind") >= n_base)
    needs = F.when(F.col("part") == "id", F.array(F.lit("key"))).when(F.col("part") == "key", F.array(F.lit("id"))).otherwise(F.array(F.lit("id"), F.lit("key")))
    asked = weak.select("doc_id", "text_key", "start", "kind", "end", F.size(needs).alias("n_needs"), F.explode(needs).alias("part")).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1))
    )
    met = asked.join(near, ["doc_id", "text_key", "part", "cell"], "left_semi") if scope <= 0 else asked.alias("a").join(
        near.alias("b"),
        (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.cell") == F.col("b.cell"))
        & (F.greatest(F.col("b.s2") - F.col("a.end"), F.col("a.start") - F.col("b.e2")) <= scope),
        "left_semi",
    )
    full = met.groupBy("doc_id", "text_key", "start", "kind", "end").agg(F.count_distinct("part").alias("n"), F.max("n_needs").alias("n_needs")).where("n = n_needs")
    return full.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind, start, end, linked) sorted by start; base spans and linked weak ones."""
    digest = _digest(docs, scope, id_col, text_col)
    names = F.array(*[F.lit(k.name) for k in KINDS])
    weak = F.array(*[F.lit(k.weak) for k in KINDS])
    return digest.select(
        "doc_id",
        F.transform(F.array_sort(F.concat("base", "extra")), lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.get(weak, s["kind"]).alias("linked"))).alias("spans"),
    )


def _digest(docs: DataFrame, scope: int, id_col: str, text_col: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "secrets")
    parts = scratch.put(scan_parts(doc_rows(docs, id_col, text_col)), "parts")
    extra = linked(parts, scope)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return parts.join(extra, ["doc_id", "text_key"], "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = _digest(table(spark, sf_dir, "documents"), SCOPE, "doc_id", "text")
    count = lambda no: F.size(F.filter("base", lambda s: s["kind"] == no)).cast("long")
    return digest.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "extra")).alias("spans"),
    )
