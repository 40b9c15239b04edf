"""The registered queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import functools
import importlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import common


#: The key of the registered query; a deployment passes its own.
KEY = "quillstone-demonstration-key"


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"), word_bpe())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(common.table(spark, sf_dir, "documents", "doc_id", "text"), KEY)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(common.table(spark, sf_dir, "documents", "doc_id", "text"), 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), 0.93)


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score

    return score(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    got = count_tokens(common.table(spark, sf_dir, "documents", "doc_id", "text"), word_bpe())
    return got.withColumn("over_limit", got["n_tokens"] > 2048)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, toxicity.toxic_labels(common.table(spark, sf_dir, "labels", "doc_id", "toxic")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(scored["doc_id"]).alias("held_out"), "score", (scored["score"] >= 0.5).cast("int").alias("predicted"), "nearest_id", "nearest_cosine", "evidence")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"), 4)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a session, once, where they cannot be expected to find it themselves."""
    package = Path(__file__).resolve().parents[1]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(package.parent) in map(os.path.realpath, filter(None, known)) or any(f"/{package.name}.zip" in x for x in spark.sparkContext.listFiles):
        return
    path = f"{tempfile.mkdtemp(prefix='quillstone-')}/{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)


def _shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_suffix_dedup, op2_packing, op3_pii, op4_sharding, op5_embeddings, op6_katz, op7_token_counts, op8_decontamination, op9_toxicity, op10_minhash, pipeline)}

_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_ALNUM.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
occ AS (SELECT doc_id, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
fr AS (SELECT t, count(*) AS n FROM pos GROUP BY t),
bn AS (SELECT row_number() OVER () AS bid, item, w FROM b WHERE len(w) > 0),
rk AS (SELECT bid, item, t, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY bid ORDER BY coalesce(n, 0), t) AS k FROM (SELECT DISTINCT bid, item, unnest(w) AS t FROM bn) LEFT JOIN fr USING (t)),
rare AS (SELECT * FROM rk WHERE k <= 4 AND bid IN (SELECT bid FROM rk WHERE k <= 4 GROUP BY bid HAVING count(*) = 4 AND min(n) > 0)),
rp AS (SELECT bid, item, k, doc_id, p FROM rare JOIN pos USING (t)),
nr AS (SELECT DISTINCT doc_id, item FROM (SELECT x.bid, x.item, x.doc_id, x.p FROM rp x JOIN rp y ON x.bid = y.bid AND x.doc_id = y.doc_id AND x.k = 1 AND y.k > 1 AND abs(x.p - y.p) <= 26
       GROUP BY x.bid, x.item, x.doc_id, x.p HAVING count(DISTINCT y.k) = 3)),
near AS (SELECT doc_id, count(*) AS n_near FROM nr ANTI JOIN (SELECT DISTINCT doc_id, item FROM occ) USING (doc_id, item) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op5_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x""",
    "op10_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
g AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN g ON d.doc_id = g.x LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op1_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, i FROM w JOIN f ON w.s = f.s WHERE first < doc_id),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM g),
q AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM q GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM r),
m AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM r GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS kept FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN m.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
}
