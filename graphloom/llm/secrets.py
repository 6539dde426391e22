"""Secret scans: patterns, and a battery of randomness tests under false-discovery control. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, table

_WORDS = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = _WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: encodings in the order in which they are tried: pattern, size of the alphabet, chance that two neighbours are of one class (lower, upper, digit, other)
ENCODINGS = [
    ("^([0-9a-f]+|[0-9A-F]+)$", 16, (10 / 16) ** 2 + (6 / 16) ** 2),
    ("^[A-Z2-7]+=*$", 32, (26 / 32) ** 2 + (6 / 32) ** 2),
    ("^[A-Za-z0-9]+$", 62, 2 * (26 / 62) ** 2 + (10 / 62) ** 2),
    ("", 64, 2 * (26 / 64) ** 2 + (10 / 64) ** 2 + (2 / 64) ** 2),
]
#: of ordinary text: the chance that two of a token's characters are equal, and that neighbours are of different classes
EQUAL, SWITCH = 0.066, 0.1
BANDS = [24, 32, 48, 96]
STEP = 0.05


def spans(text: str, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Structs (s, e, x) of the pattern's matches, from the left and without overlap, in code points; with group, only those whose group has least characters.

    The pieces between matches and the matches themselves alternate, so their lengths add up to the places."""
    t = F.col(text)
    found, gaps = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    kept = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda g: F.length(g) >= least) if group else F.transform(found, lambda g: F.lit(True))
    none = F.array().cast("array<struct<s:bigint,e:bigint,x:string>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        own = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("x"))
        return F.struct(e.alias("at"), F.when(x["k"], F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), kept.alias("k"))
    return F.when(t.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def tested(tokens: DataFrame) -> DataFrame:
    """tokens (x) with z, how unlike ordinary text they are, and random, whether no test of the battery rejects uniform randomness.

    Chi-squared: counts over the inferred alphabet. Runs: changes of character class against those expected.
    Serial correlation: of neighbours' codes. Each is a standard score that must lie within 4. z adds up,
    as standard scores under ordinary text, how few characters are equal and how often classes change."""
    n = F.length("x").cast("double")
    k, same = F.lit(float(ENCODINGS[-1][1])), F.lit(ENCODINGS[-1][2])
    for pattern, size, q in reversed(ENCODINGS[:-1]):
        fits = F.col("x").rlike(pattern)
        k, same = F.when(fits, float(size)).otherwise(k), F.when(fits, q).otherwise(same)
    rows = tokens.withColumn("v", F.transform(F.filter(F.split("x", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double")))
    rows = rows.withColumns({"n": n, "k": k, "same": same, "switch": (F.size(F.regexp_extract_all("x", F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0))) - 1).cast("double")})
    zero = F.lit(0.0)
    # equal characters stand together in the sorted token: a run of c gives c * c
    rows = rows.withColumn("squares", F.aggregate(F.array_sort("v"), F.struct(zero.alias("sum"), zero.alias("c"), F.lit(-1.0).alias("p")), lambda a, x: F.struct((a["sum"] + F.when(x == a["p"], 2 * a["c"] + 1).otherwise(1.0)).alias("sum"), F.when(x == a["p"], a["c"] + 1).otherwise(1.0).alias("c"), x.alias("p")), lambda a: a["sum"]))
    rows = rows.withColumn("mean", F.aggregate("v", zero, lambda a, x: a + x) / F.col("n"))
    rows = rows.withColumn("serial", F.aggregate("v", F.struct(zero.alias("cov"), zero.alias("var"), F.lit(None).cast("double").alias("p")), lambda a, x: F.struct((a["cov"] + F.coalesce((a["p"] - F.col("mean")) * (x - F.col("mean")), zero)).alias("cov"), (a["var"] + (x - F.col("mean")) * (x - F.col("mean"))).alias("var"), x.alias("p")), lambda a: F.when(a["var"] > 0, a["cov"] / a["var"]).otherwise(1.0)))
    n, k, same, steps = F.col("n"), F.col("k"), F.col("same"), F.col("n") - 1
    chi = (k / n * F.col("squares") - n - (k - 1)) / F.sqrt(2 * (k - 1))
    runs = (F.col("switch") - steps * (1 - same)) / F.sqrt(steps * same * (1 - same))
    pairs, equal = n * steps / 2, (F.col("squares") - n) / 2
    few = (pairs * EQUAL - equal - 0.5) / F.sqrt(pairs * EQUAL * (1 - EQUAL))
    many = (F.col("switch") - steps * SWITCH) / F.sqrt(steps * SWITCH * (1 - SWITCH))
    return rows.withColumns({"z": (few + many) / math.sqrt(2), "random": (chi <= 4) & (F.abs(runs) <= 4) & (F.abs(F.col("serial")) * F.sqrt(n) <= 4)})


def discoveries(tokens: DataFrame, rate: float = 0.001) -> DataFrame:
    """The rows of tokens (x) that look random, with at most about the share rate of ordinary ones among those of each band of lengths.

    Benjamini and Hochberg's step-up rule a band, on standard scores in bins of 0.05: the lowest score z for which
    all tokens times the normal tail beyond z are at most rate times the tokens from z on. Longer tokens can say
    more, so each band has its own cut. Only counts of bins, a bounded number, meet in one place."""
    n, band = F.length("x"), F.lit(0)
    for i, low in enumerate(BANDS, 1):
        band = F.when(n >= low, i).otherwise(band)
    rows = tested(tokens).withColumns({"band": band, "bin": F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(200.0), F.col("z"))) / STEP)})
    counts = rows.groupBy("band", "bin").agg(F.count("*").alias("c"))
    all_of, from_here = Window.partitionBy("band"), Window.partitionBy("band").orderBy(F.desc("bin"))
    z = F.col("bin") * STEP
    tail = F.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * z)
    cuts = counts.withColumns({"all": F.sum("c").over(all_of), "above": F.sum("c").over(from_here)})
    cuts = cuts.filter((z >= 1) & (F.col("all") * tail <= rate * F.col("above"))).groupBy("band").agg(F.min("bin").alias("cut"))
    return rows.join(cuts, "band").filter(F.col("random") & (F.col("bin") >= F.col("cut")))


def _named(kind: str, order: int, column: str) -> Column:
    return F.transform(column, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _joined(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Of every row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, all (structs s, o, e, kind by place) and the columns keep.

    Base spans are the patterns' matches. The battery adds the tokens of 20 characters or more that look random
    and lie in no base span, as kind random. Whole texts count; a null text is an empty one, without spans; repeated
    rows are scanned each; null ids stay; columns not named are not read; an empty table gives no rows."""
    extra = [F.col(c) for c in keep or []]
    rows = documents.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), *extra, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumns({"a": spans("t", ASSIGN, 2, 8), "k": spans("t", ACCESS), "h": spans("t", HEX), "c": spans("t", TOKEN)}).drop("t")
    rows, _ = materialise(rows.withColumn("base", F.array_sort(F.concat(_named("assign", 0, "a"), _named("access", 1, "k"), _named("hex", 2, "h")))), "spans")
    own = F.transform("found", lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("o"), x["e"].alias("e"), F.lit("random").alias("kind")))
    found = discoveries(rows.select("row_id", F.explode("c").alias("c")).select("row_id", "c.s", "c.e", "c.x")).groupBy("row_id").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    some = rows.filter(F.size("c") > 0).join(found, "row_id", "left").withColumn("found", F.coalesce("found", none))
    out = rows.filter(F.size("c") == 0).withColumn("found", none).unionByName(some)  # few rows have tokens; only these move
    out = out.withColumn("found", F.filter(own, lambda x: ~F.exists("base", lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"]))))
    everything = F.array_sort(F.concat("base", "found"))
    return out.select("doc_id", F.size("a").cast("long").alias("n_assign"), F.size("k").cast("long").alias("n_access"), F.size("h").cast("long").alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(everything).alias("spans"), everything.alias("all"), *(keep or []))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents, all columns, with every span that find_secrets() reports replaced by mark; spans that overlap become one.

    n_chars, where there is one, is counted anew for texts that changed. Every row stays, repeated ones and those with
    null ids or texts too; other columns, whatever their names, are handed on in a struct; an empty table stays empty."""
    found = find_secrets(documents.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")), keep=["row"])
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = x["e"] > acc["at"]
        apart = (x["s"] >= acc["at"]) & new
        before = F.substr(F.col("old"), (acc["at"] + 1).cast("int"), F.greatest(x["s"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(apart, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(x["e"], acc["at"]).alias("at"), out.alias("out"))

    done = F.aggregate("all", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("old"), (acc["at"] + 1).cast("int"))))
    rows = found.select("row", "all", text.alias("old")).withColumn("new", F.when(F.size("all") > 0, done))
    fields = []
    for name, kind in documents.dtypes:
        own = F.col("row")[name]
        if name == "text":
            own = F.coalesce(F.col("new"), own)
        elif name == "n_chars":
            own = F.coalesce(F.length("new").cast(kind), own)
        fields.append(own.alias(name))
    return rows.select(*fields)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' secrets."""
    return find_secrets(table(spark, sf_dir, "documents")).drop("all")


def _sql_spans(name: str, pattern: str, keep: str) -> str:
    """Rows (rid, s, e, x) of a pattern's matches."""
    p = pattern.replace("'", "''")
    return f"""
{name}_m AS (
  SELECT rid, i, m[i] AS x, g[i] AS gap{', v[i] AS v' if keep else ''} FROM (
    SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, string_split_regex(t, '{p}') AS g{f", regexp_extract_all(t, '{p}', 2) AS v" if keep else ''},
      unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) AS i FROM d)
), {name} AS (
  SELECT rid, e - length(x) AS s, e, x FROM (
    SELECT *, CAST(sum(length(gap) + length(x)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e FROM {name}_m){f' WHERE {keep}' if keep else ''}
)"""


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), {_sql_spans("a", ASSIGN, "length(v) >= 8")}, {_sql_spans("k", ACCESS, "")}, {_sql_spans("h", HEX, "")}, {_sql_spans("c", TOKEN, "")}, base AS (
  SELECT rid, s, 0 AS o, e, 'assign' AS kind FROM a UNION ALL SELECT rid, s, 1, e, 'access' FROM k UNION ALL SELECT rid, s, 2, e, 'hex' FROM h
), f AS (
  SELECT rid, s, e, x, CAST(length(x) AS DOUBLE) AS n,
    CASE WHEN regexp_matches(x, '{ENCODINGS[0][0]}') THEN 0 WHEN regexp_matches(x, '{ENCODINGS[1][0]}') THEN 1 WHEN regexp_matches(x, '{ENCODINGS[2][0]}') THEN 2 ELSE 3 END AS enc,
    CAST(len(regexp_extract_all(x, '[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+')) - 1 AS DOUBLE) AS sw FROM c
), ch AS (
  SELECT rid, s, j, CAST(ascii(substr(x, j, 1)) AS DOUBLE) AS v FROM (SELECT rid, s, x, unnest(range(1, length(x) + 1)) AS j FROM f)
), sq AS (
  SELECT rid, s, CAST(sum(n * n) AS DOUBLE) AS squares FROM (SELECT rid, s, v, count(*) AS n FROM ch GROUP BY rid, s, v) GROUP BY rid, s
), dev AS (
  SELECT rid, s, j, v - avg(v) OVER (PARTITION BY rid, s) AS y FROM ch
), ser AS (
  SELECT rid, s, CASE WHEN sum(y * y) > 0 THEN coalesce(sum(y * z), 0) / sum(y * y) ELSE 1.0 END AS r
  FROM (SELECT *, lead(y) OVER (PARTITION BY rid, s ORDER BY j) AS z FROM dev) GROUP BY rid, s
), st AS (
  SELECT f.rid, f.s, f.e, n, sw, squares, r,
    CAST(CASE enc WHEN 0 THEN 16 WHEN 1 THEN 32 WHEN 2 THEN 62 ELSE 64 END AS DOUBLE) AS k,
    CAST(CASE enc WHEN 0 THEN {ENCODINGS[0][2]!r} WHEN 1 THEN {ENCODINGS[1][2]!r} WHEN 2 THEN {ENCODINGS[2][2]!r} ELSE {ENCODINGS[3][2]!r} END AS DOUBLE) AS q
  FROM f JOIN sq ON f.rid = sq.rid AND f.s = sq.s JOIN ser ON f.rid = ser.rid AND f.s = ser.s
), z AS (
  SELECT rid, s, e,
    ((n * (n - 1) / 2 * 0.066::DOUBLE - (squares - n) / 2 - 0.5) / sqrt(n * (n - 1) / 2 * 0.066::DOUBLE * (1 - 0.066::DOUBLE)) + (sw - (n - 1) * 0.1::DOUBLE) / sqrt((n - 1) * 0.1::DOUBLE * (1 - 0.1::DOUBLE))) / sqrt(2::DOUBLE) AS z,
    (k / n * squares - n - (k - 1)) / sqrt(2 * (k - 1)) <= 4 AND abs((sw - (n - 1) * (1 - q)) / sqrt((n - 1) * q * (1 - q))) <= 4 AND abs(r) * sqrt(n) <= 4 AS random,
    CASE WHEN n >= 96 THEN 4 WHEN n >= 48 THEN 3 WHEN n >= 32 THEN 2 WHEN n >= 24 THEN 1 ELSE 0 END AS band
  FROM st
), b AS (
  SELECT *, floor(greatest(-20.0::DOUBLE, least(200.0::DOUBLE, z)) / 0.05::DOUBLE) AS bin FROM z
), cnt AS (
  SELECT band, bin, count(*) AS c FROM b GROUP BY band, bin
), cum AS (
  SELECT band, bin, sum(c) OVER (PARTITION BY band) AS total, sum(c) OVER (PARTITION BY band ORDER BY bin DESC) AS above FROM cnt
), cut AS (
  SELECT band, min(bin) AS cut FROM cum
  WHERE bin * 0.05::DOUBLE >= 1 AND total * (exp(-(bin * 0.05::DOUBLE) * (bin * 0.05::DOUBLE) / 2) / (sqrt(2 * pi()) * (bin * 0.05::DOUBLE))) <= 0.001::DOUBLE * above GROUP BY band
), everything AS (
  SELECT * FROM base UNION ALL
  SELECT b.rid, b.s, 3, b.e, 'random' FROM b JOIN cut ON b.band = cut.band AND b.bin >= cut.cut
  WHERE b.random AND NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = b.rid AND x.s <= b.s AND b.e <= x.e)
), j AS (
  SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans, string_agg(CASE WHEN o < 3 THEN kind || ':' || s || ':' || e END, ',' ORDER BY s, o) AS base,
    count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex
  FROM everything GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON d.rid = j.rid
"""
