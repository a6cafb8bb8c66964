"""The registered queries of these operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payrecheck.llm import (
    boilerplate,
    bpe,
    decontaminate,
    langid,
    licences,
    merkle,
    ngram_join,
    pieces,
    pseudonyms,
    quality,
    sharding,
    suffix_dedup,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@registered()
def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word n-grams, Jaccard 0.9."""
    return ngram_join.link_documents(table(spark, folder, "documents"))


# Pages are distinct texts of a host; @norm@ is the compared form of a line.
_LINES = r"""
docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
pages AS (SELECT DISTINCT host, text FROM docs),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY 1),
raw AS (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM pages),
lines AS (
  SELECT host, text, @norm@ AS line,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
counts AS (SELECT host, line, count(DISTINCT text) AS n FROM lines GROUP BY 1, 2),
often AS (
  SELECT host, line FROM counts JOIN totals USING (host)
  WHERE n >= 5 AND n > CAST(0.1 AS DOUBLE) * pages)
"""


@registered(
    "WITH "
    + _LINES.replace("@norm@", "trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '))")
    + r""",
each AS (
  SELECT host, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS k FROM pages),
marked AS (
  SELECT e.host, e.text, e.k, e.line, o.line IS NOT NULL AS gone
  FROM each e LEFT JOIN often o ON o.host = e.host
   AND o.line = trim(translate(e.line, chr(9) || chr(11) || chr(12) || chr(13), '    '))
   AND regexp_matches(e.line, '[^\x20\x09-\x0D]')),
cleaned AS (
  SELECT host, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS cleaned
  FROM marked GROUP BY 1, 2)
SELECT d.doc_id, c.n_lines, c.n_dropped, c.cleaned AS text
FROM docs d JOIN cleaned c ON c.host = d.host AND c.text = d.text
"""
)
def op2_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without the lines that are boilerplate within their source."""
    cleaned = boilerplate.drop_boilerplate(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text")


@registered(
    "WITH "
    + _LINES.replace(
        "@norm@",
        r"regexp_replace(regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]', '0', 'g'), '0+', '0', 'g')",
    )
    + r""",
thin AS (
  SELECT host, text, sum(w) FILTER (WHERE o.line IS NOT NULL) AS gone
  FROM lines LEFT JOIN often o USING (host, line) GROUP BY 1, 2),
words AS (
  SELECT host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM pages),
wins AS (
  SELECT host, text, k, array_to_string(w[k : k + 4], ' ') AS win
  FROM (SELECT host, text, w, unnest(range(1, len(w) - 3)) AS k FROM words WHERE len(w) > 5)),
twice AS (
  SELECT host, text, k FROM wins QUALIFY count(*) OVER (PARTITION BY host, text, win) > 1),
reps AS (
  SELECT host, text, count(DISTINCT p) AS n
  FROM (SELECT host, text, unnest(range(k, k + 5)) AS p FROM twice) GROUP BY 1, 2),
dups AS (
  SELECT host, text, count(*) - count(DISTINCT line) AS n
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
stats AS (
  SELECT host, text, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(dups.n, 0) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words,
         coalesce(thin.gone, 0) AS gone
  FROM words LEFT JOIN dups USING (host, text) LEFT JOIN reps USING (host, text)
  LEFT JOIN thin USING (host, text))
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND n_words - gone >= 10 AND n_words - gone >= CAST(0.5 AS DOUBLE) * n_words AS kept
FROM docs d JOIN stats s ON s.host = d.host AND s.text = d.text
"""
)
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Word statistics and verdict of every document."""
    judged = quality.judge_quality(table(spark, folder, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@registered()
def op3_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items within documents: word 5-grams, weighted similarity 0.8."""
    return decontaminate.find_items(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@registered()
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every text, as their number and hash, and whether they decode to it."""
    model = pieces.load_model()
    coded = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), model)
    # Decoding carries digests of the texts, not the texts.
    coded = coded.select("doc_id", "ids", F.sha2("text", 256).alias("text_sha256"))
    return pieces.decode(coded, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).eqNullSafe(F.col("text_sha256")).alias("round_trip"),
    )


@registered()
def op4_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document; the law is ``rows``."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return sharding.shuffle_records(table(spark, folder, "documents")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: For tests; users pass a secret of their own.
DEMONSTRATION_KEY = b"not a secret: for tests only"


@registered()
def op6_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """All texts under pseudonyms, with the number of values of each kind."""
    done = pseudonyms.pseudonymise(
        table(spark, folder, "documents").select("doc_id", "text"), DEMONSTRATION_KEY
    )
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
        for k in pseudonyms.KINDS
    ]
    return done.select("doc_id", F.size("found").cast("long").alias("n_found"), *counts, "text")


@registered()
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text, learnt from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@registered()
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every text loses when its 400-byte strings that start elsewhere too are removed."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.aggregate(
            "removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]
        ).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@registered()
def op5_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every paragraph that is a licence notice, with its family."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licences.scan_licences(docs, licences.train(docs))


@registered()
def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Word BPE ids of every whole text, and their text, as number and hashes."""
    vocabulary = bpe.load_vocabulary()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.decode(bpe.encode(docs, vocabulary).drop("text"), vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _merkle_sql(levels: int = 6, top_levels: int = 4) -> str:
    """The manifest of op12 in SQL, for up to 16**levels rows of a source."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]

    def leaf(text: str) -> str:
        values = [*(f"CAST({c} AS VARCHAR)" for c in fields[:-1]), text]
        parts = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values]
        return f"sha256({' || '.join(parts)})"

    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = f"translate(text, '{capitals}', '{capitals.lower()}')"
    steps = [
        # CRC-32 of the digits: a byte is mixed in, then eight shifts.
        f"""crcs AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b)
                   WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS crc
  FROM documents)""",
        f"""d AS (
  SELECT doc_id, {leaf("text")} AS leaf,
         CASE WHEN crc % 5 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS claim,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf("text")}) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM crcs)""",
        "l0 AS (SELECT tree, pos, n, leaf AS h FROM d)",
    ]

    def grow(name: str, count: int) -> None:
        for k in range(count):
            steps.append(
                f"""{name}{k + 1} AS (
  SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h
  FROM {name}{k} WHERE n > 1 GROUP BY 1, pos // 16, n)"""
            )
            steps.append(
                f"""{name}s{k} AS (
  SELECT a.tree, a.pos,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS bef,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS aft
  FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.pos // 16 = b.pos // 16
  WHERE a.n > 1 GROUP BY 1, 2)"""
            )

    def ends(name: str, count: int) -> str:
        return " UNION ALL ".join(
            f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(count + 1)
        )

    grow("l", levels)
    steps.append(f"subs AS ({ends('l', levels)})")
    steps.append("t0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM subs)")
    grow("t", top_levels)
    steps.append(f"roots AS ({ends('t', top_levels)})")
    steps.append("f0 AS (SELECT *, '' AS proof, claim AS folded FROM d)")
    joins = [("l", k, "f.tree", "f.pos") for k in range(levels)]
    joins += [("t", k, "0", "f.tree") for k in range(top_levels)]
    for at, (name, k, tree, pos) in enumerate(joins):
        steps.append(
            f"""f{at + 1} AS (
  SELECT f.* REPLACE (f.proof || coalesce(s.bef || s.aft, '') AS proof,
    CASE WHEN s.pos IS NULL THEN f.folded ELSE sha256(s.bef || f.folded || s.aft) END AS folded)
  FROM f{at} f LEFT JOIN {name}s{k} s ON s.tree = {tree} AND s.pos = {pos} // {16**k})"""
        )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256,
       f.folded AS folded_root, f.folded = r.h AS verified
FROM f{len(joins)} f JOIN subs s ON s.tree = f.tree CROSS JOIN roots r
"""
    )


@registered(_merkle_sql())
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root and checked proof of every document."""
    manifest = merkle.document_manifest(table(spark, folder, "documents"))
    proved = merkle.prove(manifest, "claim", ["key"])
    return proved.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        "verified",
    )


@registered()
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The whitened components of every usable embedding, up to 32."""
    x = whitening.usable(table(spark, folder, "embeddings"), "embedding", ["vec_id"])
    model = whitening.fit(x, 32)
    if model is None:
        nothing = "vec_id long, component int, n long, deviation long, whitened double"
        return spark.createDataFrame([], f"{nothing}, explained double, identity_error double")
    error = whitening.identity_error(x, model)
    rows = whitening.whiten(x, model, ["vec_id"])
    explained = F.array(*[F.lit(v) for v in model.explained])
    return rows.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
