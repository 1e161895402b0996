r"""Secret scans with multipart credential linking.

A text is scanned for strong parts (assigned secrets, access keys, long hex) and weak
ones (a bare mixed token, a named account, an endpoint address). Strong parts are always
reported. A weak part alone is mostly noise, so it is reported only when the parts that
complete it stand within ``SCOPE`` code points: an interval join on (row, bin of
positions) pairs each weak part with the parts around it.

Positions: Java's regex gives the matches and the pieces between them; running sums of
their lengths are code point offsets. Everything is DataFrame expressions.

Defined results: null and empty texts have no spans; a row is its own scope, also where
doc_ids repeat or are null; equal spans of two kinds are both listed; order is by start,
then by kind as listed in ``KINDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import cut, fresh_names, own_columns, text_key

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts: an account name, a bare token of 24 characters or more, an address.
ACCOUNT = (
    r"""([Uu][Ss][Ee][Rr]([Nn][Aa][Mm][Ee]|_[Ii][Dd])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_[Ii][Dd])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
)
BARE = r"[A-Za-z0-9+/_-]{24,}"
ENDPOINT = r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._:@-]+"

KINDS = ("assign", "access", "hex", "account", "bare", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, ACCOUNT, BARE, ENDPOINT), strict=True))
VALUE_GROUP = {"assign": 2, "account": 3}
SHORTEST_VALUE = {"assign": 8, "account": 3}
BASE = 3
SCOPE = 200
MASK = "[SECRET]"

#: The role each kind plays in a credential, and the roles that must be near a weak kind.
ROLE = {"assign": "secret", "hex": "secret", "bare": "secret", "access": "id", "account": "id", "endpoint": "place"}
NEEDS = {"account": ("secret",), "bare": ("id",), "endpoint": ("id", "secret")}


def _found(text: Column, kind: str) -> Column:
    """Per match: length of the piece before it, of the match and of its value."""
    pattern, group = F.lit(PATTERNS[kind]), VALUE_GROUP.get(kind, 0)
    before, whole = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, 0)
    value = F.regexp_extract_all(text, pattern, group) if group else whole
    rows = F.transform(
        F.arrays_zip(F.slice(before, 1, F.size(whole)).alias("b"), whole.alias("w"), value.alias("v")),
        lambda m: F.struct(
            F.length(m["b"]).alias("before"), F.length(m["w"]).alias("whole"), F.length(m["v"]).alias("value"),
            _mixed(m["w"]).alias("mixed") if kind == "bare" else F.lit(True).alias("mixed"),
        ),
    )
    return F.when(text.rlike(PATTERNS[kind]), rows)


def _mixed(token: Column) -> Column:
    return token.rlike("[A-Z]") & token.rlike("[a-z]") & token.rlike("[0-9]")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, in the shared folder: row_no, doc_id, text_key, spans.

    spans: array of (start, rank, kind, end, base), sorted; end is exclusive.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
            "doc_id", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row_no"),
            *[_found(F.col("text"), k).alias(k) for k in KINDS],
        ),
        "scan",
    )
    hits = rows.filter(" OR ".join(f"{k} IS NOT NULL" for k in KINDS)).select(
        "row_no", F.explode(F.array(*[
            F.struct(F.lit(r).alias("rank"), F.lit(k).alias("kind"), F.col(k).alias("found")) for r, k in enumerate(KINDS)
        ])).alias("k"),
    )
    order = Window.partitionBy("row_no", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = cut(
        hits.select("row_no", "k.rank", "k.kind", F.posexplode("k.found").alias("pos", "m"))
        .select("*", F.sum(F.col("m.before") + F.col("m.whole")).over(order).alias("end"))
        .filter(
            F.col("m.mixed")
            & F.when(F.col("kind") == "assign", F.col("m.value") >= SHORTEST_VALUE["assign"])
            .when(F.col("kind") == "account", F.col("m.value") >= SHORTEST_VALUE["account"])
            .otherwise(True)
        )
        .select("row_no", "rank", "kind", (F.col("end") - F.col("m.whole")).alias("start"), "end"),
        "parts",
    )
    strong = parts.filter(F.col("rank") < BASE)
    spans = strong.unionByName(linked(parts)).groupBy("row_no").agg(
        F.sort_array(F.collect_list(F.struct(
            "start", "rank", "kind", "end", (F.col("rank") < BASE).alias("base")
        ))).alias("spans")
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean>>")
    return rows.select("row_no", "doc_id", "text_key").join(spans, "row_no", "left").withColumn(
        "spans", F.coalesce("spans", none)
    )


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts whose complementary parts stand within ``scope`` code points.

    Each part is put in the bins of positions that it touches once widened; a weak part
    looks in the bins of its own span. Parts do not overlap within a kind, so a bin holds
    a bounded number of them however long the text is.
    """
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    needs = F.create_map(*[y for k, v in NEEDS.items() for y in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    weak = parts.filter(F.col("rank") >= BASE)
    around = parts.select(
        "row_no", F.col("kind").alias("kind2"), role[F.col("kind")].alias("role"),
        F.col("start").alias("start2"), F.col("end").alias("end2"),
        bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("bin"),
    )
    probes = weak.select("*", bins(F.col("start"), F.col("end") - 1).alias("bin"))
    near = (
        (F.col("kind2") != F.col("kind"))
        & (F.col("start2") - scope < F.col("end")) & (F.col("end2") + scope > F.col("start"))
    )
    # A weak part inside a strong span tells nothing new.
    return (
        probes.join(around, ["row_no", "bin"]).filter(near)
        .groupBy("row_no", "rank", "kind", "start", "end")
        .agg(
            F.collect_set("role").alias("roles"),
            F.max((F.col("kind2").isin(*KINDS[:BASE])) & (F.col("start2") <= F.col("start")) & (F.col("end2") >= F.col("end"))).alias("covered"),
        )
        .filter(~F.col("covered") & (F.size(F.array_except(needs[F.col("kind")], "roles")) == 0))
        .select("row_no", "rank", "kind", "start", "end")
    )


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masks(flagged: DataFrame, *key: str) -> DataFrame:
    """key, masks: per key of ``flagged`` (key, spans) what is to be masked, in order.

    Spans that overlap become one mask; spans that only touch stay two.
    """
    order = Window.partitionBy(*key).orderBy("s.start", "s.rank")
    before = F.max("s.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        flagged.select(*key, F.explode("spans").alias("s"))
        .withColumn("new", (F.col("s.start") >= F.coalesce(before, F.lit(0))).cast("int"))
        .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    merged = runs.groupBy(*key, "run").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"))
    return merged.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("masks"))


#: Masks that are cut out of one piece of a text.
PIECE = 64


def masked(text: Column, at: Column) -> Column:
    """``text`` with ``MASK`` for every mask of ``at``.

    Positions in a text are found by walking it. So a text is first cut into pieces of
    ``PIECE`` masks and then each piece into the gaps between them.
    """
    end_of = lambda g: F.coalesce(F.get(at, g - 1)["end"], F.lit(0))
    start_of = lambda g: F.coalesce(F.get(at, g)["start"], F.lit((1 << 31) - 1))
    part = lambda t, low, high: F.substring(t, (low + 1).cast("int"), (high - low).cast("int"))

    def piece(b: Column) -> Column:
        first, last = b * PIECE, F.least(b * PIECE + PIECE - 1, F.size(at))
        low = end_of(first)
        gaps = lambda own: F.transform(F.sequence(first, last), lambda g: part(own, end_of(g) - low, start_of(g) - low))
        return F.transform(F.array(part(text, low, start_of(last))), lambda own: F.array_join(gaps(own), MASK))[0]

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(at) / PIECE).cast("int")), piece), MASK)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span replaced by ``MASK``; n_chars follows the text.

    Overlapping spans become one mask; texts without spans, null texts and other columns,
    whatever their names, are unchanged.
    """
    i, key, own, h, new = fresh_names(docs, "id_", "key_", "masks_", "h_", "masked_")
    flagged = (
        scan(docs.select("doc_id", "text")).filter(F.size("spans") > 0)
        .groupBy("doc_id", "text_key").agg(F.first("spans").alias("spans"))
    )
    found = cut(masks(flagged, "doc_id", "text_key").toDF(i, key, own), "flagged")
    text, at = F.col("text"), F.col(own)
    out = (
        docs.withColumn(h, text_key())
        .join(found, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(key)), "left")
        .withColumn(new, F.when(at.isNotNull(), masked(text, at)).otherwise(text))
    )
    change = {"text": F.col(new), "n_chars": F.when(at.isNotNull(), F.length(new).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[change.get(c, own_column).alias(c) for c, own_column in zip(docs.columns, own_columns(docs), strict=True)])
