"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from . import bpe, langid, lm, merkle, packing, quality, runs, secrets, simhash, token_counts, token_files, topk, toxicity
from .common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(run):
    QUERIES[run.__name__] = run
    return run


@_query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of at most 2,048 tokens."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_best_fit(checkpointed(pieces))  # else each task has a second Python worker beside the first


@_query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written in blocks in ascending doc_id order and read back from the files."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(manifest, with_ids=False)


@_query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the ranks and decoded again, as digests."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of three-word shingles and its group at two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity, learned from the labelled documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language, learned from the documents outside the held-out quarter."""
    model = langid.fit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    found = langid.predict(table(spark, sf_dir, "documents", "doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@_query
def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's probability under the model learned from the documents outside the held-out seventh."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    words, model = lm.train(docs.where(remainder(F.col("doc_id"), 7) != 2))
    return lm.score(docs, words, model).select(
        "doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")


@_query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest products of every 50th vector with all others."""
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


SQL["op5_top_k"] = """
    with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
               where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
         s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
               from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
         r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 5"""


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's counts and verdict."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = quality.measured(docs, quality.references(docs))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


@_query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's secrets."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k, *_ in secrets.KINDS), F.sha2(secrets.listed("base_spans"), 256).alias("base_sha256"), secrets.listed("all_spans").alias("spans"))


@_query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes and tokens."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and the root folded again after half of the texts have lost their line ends."""
    docs = table(spark, sf_dir, "documents", *merkle.COLUMNS)
    tampered = (remainder(F.col("doc_id"), 2) == 0) & F.contains("text", F.lit("\n"))
    found = merkle.manifest(docs, claimed=(tampered, {"text": F.replace("text", F.lit("\n"), F.lit(""))}), with_proofs=False)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Levels written out in the manifest's SQL: groups of up to 3^12 rows, and as many groups.
_LEVELS = 12


def _manifest_sql() -> str:
    size = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(size, ('doc_id', 'source', 'lang', 'n_chars')))} || {size(text)})"
    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(cast(doc_id as varchar)) + 1), lambda i: ascii(substr(cast(doc_id as varchar), i, 1)))),"
           " lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    parts = [f"""with t0 as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as size
        from (select doc_id, source, {leaf("text")} as leaf, case when coalesce({crc}, 0) % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end as claimed from documents)),
        n0 as (select coalesce('1' || source, '0') as g, pos, size, leaf as d from t0)"""]

    def levels(n: str, sides: str) -> None:
        for k in range(_LEVELS + 1):
            parts.append(f"""{sides}{k} as (select g, pos, size, coalesce(string_agg(d, '') over (partition by g, pos // 3 order by pos rows between unbounded preceding and 1 preceding), '') as l,
                coalesce(string_agg(d, '') over (partition by g, pos // 3 order by pos rows between 1 following and unbounded following), '') as r from {n}{k})""")
            if k < _LEVELS:
                parts.append(f"""{n}{k + 1} as (select g, pos // 3 as pos, cast(ceil(max(size) / 3.0) as bigint) as size,
                    case when max(size) = 1 then max(d) else sha256(string_agg(d, '' order by pos)) end as d from {n}{k} group by g, pos // 3)""")

    levels("n", "s")
    parts.append(f"m0 as (select '' as g, row_number() over (order by g) - 1 as pos, count(*) over () as size, d, g as own from n{_LEVELS})")
    levels("m", "z")
    parts.append("""f0 as (select t0.doc_id, t0.leaf, t0.claimed as f, '' as proof, coalesce('1' || t0.source, '0') as g, t0.pos, m0.pos as place, m0.d as subroot from t0 join m0 on m0.own = coalesce('1' || t0.source, '0'))""")
    at = "f{k}"
    for k in range(2 * _LEVELS):
        side, on = (f"s{k}", f"x.g = f.g and x.pos = f.pos // {3**k}") if k < _LEVELS else (f"z{k - _LEVELS}", f"x.pos = f.place // {3**(k - _LEVELS)}")
        parts.append(f"""f{k + 1} as (select f.* replace (case when x.size = 1 then f.f else sha256(x.l || f.f || x.r) end as f,
            case when x.size = 1 then f.proof else f.proof || x.l || x.r end as proof) from {at.format(k=k)} f join {side} x on {on})""")
    return ",\n".join(parts) + f"""
        select f.doc_id, f.leaf, f.subroot, m.d as root, sha256(f.proof) as proof_sha256, f.f as folded_root, f.f = m.d as verified from f{2 * _LEVELS} f cross join m{_LEVELS} m"""


SQL["op12_merkle_manifest"] = _manifest_sql()


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's runs, after a tenth of the texts have had a stretch repeated."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    planted = docs.withColumn("plant", F.when(h % 10 == 0, F.floor(h / 10)))
    return runs.periodic_runs(planted, plant="plant", collapsed=False).drop("runs", "collapsed")
