"""Secret scan with multipart credential linking, in DataFrame operations alone.

Strong spans are found by three patterns (assign, access, hex). Weak parts (identifiers, secret-looking
values, endpoints) are common in clean text and are reported only where parts that complement each other
lie in one scope: the interval between two blank lines, whatever its length. An identifier needs a secret,
a secret needs an identifier or an endpoint, an endpoint needs a secret; strong spans count as parts too.

Places come from the lengths between matches: a text split by a pattern gives the gaps, and a running
sum over a row's matches gives code-point offsets. The interval join is a sweep over a row's parts in
order: blank lines passed number the scope of each part, and each part meets the roles its scope holds, so no
pairs are made. Only lengths and kinds are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dzvin.llm.common import cut_lineage

VALUE = "[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = f"(?i:(password|passwd|secret|token|api_?key)){VALUE}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ENDPOINT = "(?:(?i:https?|s3|gs|ftp|redis|amqps?|mongodb|postgres(?:ql)?|mysql)://[^\\x20\\t\\r\\n\"'<>]+|(?<![A-Za-z0-9])(?i:host|hostname|endpoint|server|bucket)" + VALUE + "[A-Za-z0-9.:/_-]{3,})"
IDENT = "(?:(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}|(?<![A-Za-z0-9])(?i:access_?key_?id|key_?id|client_?id|account_?id|user_?name|user|login)" + VALUE + "[A-Za-z0-9@._-]{3,})"
SECRET = "(?:(?<![A-Za-z0-9])(?i:client_?secret|secret_?key|secret_?access_?key|access_?key|private_?key|auth_?key|pass_?phrase|pass|pwd|auth|credentials?|bearer)" + VALUE + "[A-Za-z0-9+/_.=-]{6,}|[A-Za-z0-9+/]{20,}={0,2})"
WEAK = f"{ENDPOINT}|{IDENT}|{SECRET}"
BREAK = "\\n[\\x20\\t\\r]*\\n"
#: Kinds in the order in which spans at one place are listed.
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint"]


def _matches(text: Column, pattern: str, family: int, kind) -> Column:
    """Structs (family, place among its matches, code points before it since the last, length, kind or null)."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.transform(found, lambda m, k: F.struct(F.lit(family).alias("family"), k.alias("k"), F.length(F.get(gaps, k)).alias("gap"), F.length(m).alias("len"), kind(m, k).alias("kind")))


def _weak_kind(m: Column) -> Column:
    mixed = m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    labelled = m.rlike("[:=]\\x20*[\"']?[^\\x20]")
    return F.when(m.startswith("\n"), "break").when(m.rlike(f"^{ENDPOINT}$"), "weak_endpoint").when(m.rlike(f"^{IDENT}$"), "weak_id").when(labelled | mixed, "weak_secret")


def parts(text: Column) -> Column:
    """All matches of a text, as one array."""
    none = F.array().cast("array<struct<family:int,k:int,gap:int,len:int,kind:string>>")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    families = [
        (ASSIGN, ASSIGN, lambda m, k: F.when(F.length(F.get(values, k)) >= 6, "assign")),
        (ACCESS, ACCESS, lambda m, k: F.lit("access")),
        (HEX, HEX, lambda m, k: F.lit("hex")),
        (WEAK, f"{BREAK}|{WEAK}", lambda m, k: _weak_kind(m)),
    ]
    return F.concat(*(F.when(text.rlike(asks), _matches(text, pattern, j, kind)).otherwise(none) for j, (asks, pattern, kind) in enumerate(families)))


def link(rows: DataFrame) -> DataFrame:
    """(row, part struct or null) -> row, spans: one row per distinct `row`, with a sorted array of structs
    (start, rank, end, kind), empty where there are none.
    """
    flat = rows.select("row", "part.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "family").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    placed = flat.select("row", "kind", (end - F.col("len")).alias("start"), end.alias("end"))
    base = F.coalesce(F.col("kind").isin("assign", "access", "hex"), F.lit(False))
    # Equal starts: strong spans first, whichever way the sweep goes.
    strong_first = F.when(base, 0).otherwise(1)
    down = Window.partitionBy("row").orderBy("start", strong_first, "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("row").orderBy(F.desc("start"), strong_first, "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.withColumns({
        "base_end": F.max(F.when(base, F.col("end"))).over(down),
        "base_start": F.min(F.when(base, F.col("start"))).over(up),
        "scope": F.count_if(F.col("kind") == "break").over(down),
    })
    covered = F.coalesce(F.col("base_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("base_start") < F.col("end"), F.lit(False))
    role = F.when(F.col("kind").isin("assign", "hex"), "secret").when(F.col("kind") == "access", "id")
    role = role.when(covered, None).when(F.col("kind") == "weak_secret", "secret").when(F.col("kind") == "weak_id", "id").when(F.col("kind") == "weak_endpoint", "endpoint")
    swept = swept.withColumn("role", role)
    scope = Window.partitionBy("row", "scope")
    # A part has one role and needs another, so it never stands for its own complement.
    with_near = swept.withColumns({f"near_{r}": F.coalesce(F.bool_or(F.col("role") == r).over(scope), F.lit(False)) for r in ("id", "secret", "endpoint")})
    linked = F.when(F.col("role") == "secret", F.col("near_id") | F.col("near_endpoint")).when(F.col("role").isNotNull(), F.col("near_secret"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("kind"))
    return with_near.groupBy("row").agg(F.sort_array(F.collect_list(F.when(base | linked, span))).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans, an array of structs (start, rank, end, kind), by place.

    Offsets are code points, ends exclusive. Null is an empty text; rows without spans have an empty array;
    repeated rows and ids are scanned each for itself. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("no"), F.col(id_col).alias("doc_id")).alias("row"), text.alias("t"))
    found = link(rows.select("row", F.explode_outer(parts(F.col("t"))).alias("part")))
    return found.select("row.doc_id", "spans")


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", size_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns; each run of overlapping spans in the text is replaced by a mark.

    A length column, if there is one of that name, is set anew for changed rows. The patterns run once over each
    text; rows meet their spans by a row number, so null and repeated ids stay apart. `docs` is read twice and
    must give its rows in the same order, as a stored table does.
    """
    n = len(docs.columns)
    held = docs.toDF(*(f"c{k}" for k in range(n))).withColumn("row", F.monotonically_increasing_id())
    text = f"c{docs.columns.index(text_col)}"
    found = cut_lineage(link(held.select("row", F.explode(parts(F.coalesce(F.col(text), F.lit("")))).alias("part"))).where(F.size("spans") > 0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("made"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        return F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.when(s["start"] < a["at"], a["made"]).otherwise(F.concat(a["made"], gap, F.lit(mark))).alias("made")))

    fold = F.aggregate("spans", start, step)
    joined = held.join(found, "row", "left").withColumn("f", fold)
    made = F.when(F.col("spans").isNull(), F.col(text)).otherwise(F.concat(F.col("f.made"), F.expr(f"substring(`{text}`, cast(f.at + 1 as int))")))
    out = []
    for k, f in enumerate(docs.schema):
        col = made if k == docs.columns.index(text_col) else F.when(F.col("spans").isNull(), F.col(f"c{k}")).otherwise(F.length(made)) if f.name == size_col else F.col(f"c{k}")
        out.append(col.cast(f.dataType).alias(f.name))
    return joined.select(*out)
