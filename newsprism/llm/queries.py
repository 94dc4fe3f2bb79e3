"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table

# Vocabulary files of the installed public tokenizers (parameters, never copied here).
BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import main_text

    return main_text(spark, read_table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score_quality(spark, docs, labels)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removed_spans

    return removed_spans(spark, read_table(spark, sf_dir, "documents")).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score_toxicity(spark, docs, labels)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordpiece import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary_file(BYTE_RANKS))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    docs = read_table(spark, sf_dir, "documents")
    return pack(spark, docs, tokenizer=vocabulary_file(WORD_TOKENIZER))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(spark, read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    docs, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return find_leaks(spark, docs, benchmark)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_join import near_duplicates

    return near_duplicates(spark, read_table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(spark, read_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import rank_documents

    docs, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return rank_documents(spark, docs, benchmark)


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn_join import top_inner_products

    return top_inner_products(spark, read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_pii": op8_pii,
    "op9_decontamination": op9_decontamination,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_topk_search": op13_topk_search,
}
ORACLE_SQL: dict[str, str] = {
    "op12_lexical_search": r"""
with words as (
  select doc_id, row_number() over () as d,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
items as (
  select item_id, row_number() over () as i,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from (select distinct item_id, text from benchmark where text is not null)),
held as (select d, doc_id, terms, len(terms)::bigint as n from words where len(terms) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as words from held),
queried as (select i, item_id, term, count(*)::bigint as times
            from (select i, item_id, unnest(terms) as term from items) group by i, item_id, term),
postings as (select d, doc_id, n, term, count(*)::bigint as tf
             from (select d, doc_id, n, unnest(terms) as term from held) group by d, doc_id, n, term),
frequency as (select term, count(*)::bigint as df from postings group by term),
weights as (select q.i, q.item_id, q.term, q.times,
              floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
            from queried q join frequency f on q.term = f.term cross join total),
scores as (select i, item_id, d, doc_id,
             sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::bigint as score
           from weights join postings using (term) cross join total group by i, item_id, d, doc_id),
ranked as (select item_id, row_number() over (partition by i order by score desc, doc_id)::int as rank, doc_id, score
           from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20""",
    "op13_topk_search": r"""
with parts as (
  select r, vec_id, unnest(embedding)::double as c, generate_subscripts(embedding, 1) as i
  from (select row_number() over () as r, vec_id, embedding from embeddings where vec_id is not null)),
sound as (select r from parts group by r having bool_and(c is not null and isfinite(c))),
entries as (select r, vec_id, i, floor(1024 * c)::bigint as x from parts semi join sound using (r)),
scores as (
  select q.r as q, c.r as c, q.vec_id as query_id, c.vec_id, sum(q.x * c.x)::bigint as score
  from entries q join entries c on q.i = c.i and q.r <> c.r
  where q.vec_id % 100 = 0 group by q.r, c.r, q.vec_id, c.vec_id),
ranked as (select query_id, row_number() over (partition by q order by score desc, vec_id)::int as rank, vec_id, score
           from scores)
select query_id, rank, vec_id, score from ranked where rank <= 10""",
}
