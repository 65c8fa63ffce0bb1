"""Registered queries of the operators, with production parameters over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import (
    decontaminate, language_id, lexical, lm_scores, near_dup, packing, periodic, pii, quality, token_counts, topk, url_filters, warc,
)
from rollcall.sources.lineage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int) -> Column:
    """Remainder of the checksum of the id as text; -1 for rows without id, which are held out of nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % by, F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, remainder(4) != 2)
    return language_id.identify(docs, model, "doc_id").select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(table(spark, sf_dir, "documents"), remainder(10) != 0)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_filters.mine(pages, table(spark, sf_dir, "labels"))
    return url_filters.judge(pages, rules)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.spans_text(F.col("found")).alias("spans")
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/rollcall/{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def with_cycles(docs: DataFrame) -> DataFrame:
    """`doc_id, text`: documents whose checksum of the id is a multiple of ten go on in cycles from a word on; the others as they are."""
    check = F.crc32(F.col("doc_id").cast("string"))
    tenth = F.floor(check / 10).cast("long")

    def cycled(words: Column) -> Column:
        n = F.size(words)
        first = tenth % n
        period = 1 + F.floor((n - first) / (3 + tenth % 8)).cast("long")
        at = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i))), " ")

    words = quality.found(F.col("text"), quality.WORD)
    chosen = (check % 10 == 0) & F.rlike(F.col("text"), F.lit(quality.WORD))
    return docs.select("doc_id", F.when(chosen, quality.let(words, cycled)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(with_cycles(table(spark, sf_dir, "documents")))
    rows = found.withColumn("best", periodic.strongest(F.col("runs")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(periodic.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_token_counts, op3_lm_scores, op4_topk, op5_near_dup, op6_decontaminate, op7_packing, op8_url_filters, op9_pii, op10_warc,
                              op11_lexical_search, op12_quality_rules, op13_periodic_runs)
}

ORACLE: dict[str, str] = {
    "op4_topk": """
        with sound as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
            where vec_id is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        scored as (
            select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
            from sound q join sound c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        )
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
        from scored qualify rank <= 5
    """,
    "op10_warc": """
        with payloads as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as sha from pages),
        firsts as (select sha, min(page_id) as first from payloads group by sha)
        select page_id, strlen(payload)::bigint as payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(sha, (1 + i // 4 * 5)::int, 5))::bigint >> (15 - i % 4 * 5)) & 31)::int, 1)), '') as payload_digest,
            case when page_id = first or first is null or page_id is null and first is null then 'response' else 'revisit' end as record_type,
            case when page_id is distinct from first then first end as refers_to
        from payloads join firsts using (sha)
    """,
    "op11_lexical_search": r"""
        with texts as (
            select doc_id, row_number() over () as r, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
            from documents
        ),
        asked as (
            select distinct item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w
            from benchmark
        ),
        totals as (select count(*) as nn, sum(len(words))::bigint as ll from texts where len(words) > 0),
        tf as (select r, w, count(*) as tf from (select r, unnest(words) as w from texts) group by r, w),
        df as (select w, count(*) as df from tf where w in (select w from asked) group by w),
        weights as (select item_id, w, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint as weight from asked join df using (w), totals),
        scored as (
            select item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(words) * nn) // ll)))))::bigint as score
            from weights join tf using (w) join texts using (r), totals group by item_id, r
        )
        select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score
        from scored join texts using (r) where score > 0 qualify rank <= 10
    """,
    "op12_quality_rules": r"""
        with docs as (
            select row_number() over () as r, doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as ws,
                regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') as ls
            from documents
        ),
        words as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from docs),
        passages as (select r, i, w, lead(w) over o as w2, lead(w, 2) over o as w3 from words window o as (partition by r order by i)),
        twice as (select r, i from passages where w3 is not null qualify count(*) over (partition by r, w, w2, w3) >= 2),
        covered as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from twice) group by r),
        sizes as (
            select r, doc_id, lang, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as lines,
                len(regexp_extract_all(text, '\p{Lu}')) as capital, len(regexp_extract_all(text, '\p{Nd}')) as digit,
                len(regexp_extract_all(text, '[.,;:!?''"()-]')) as stop, len(regexp_extract_all(text, '[\p{P}\p{S}]')) as mark,
                length(text) as chars, len(ls) as letters
            from docs
        ),
        measured as (
            select r, doc_id, lang, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
                coalesce(n_repeat_words, 0) as n_repeat_words, chars, letters, [capital, digit, stop, mark - stop, chars - word_chars,
                chars - capital - digit - mark - (chars - word_chars)] as bins
            from sizes left join covered using (r)
        ),
        steps as (
            select lang, b, step, count(*) as n from (
                select lang, unnest(range(1, 7)) as b, floor(1000 * unnest(bins) / chars) as step from measured where lang is not null and chars >= 200)
            group by all
        ),
        medians as (
            select lang, b, min(step) / 1000 + 0.0005 as share from (
                select *, sum(n) over (partition by lang, b order by step) as upto, sum(n) over (partition by lang, b) as whole from steps)
            where 2 * upto >= whole group by lang, b
        ),
        shares as (select lang as ref, b, share / sum(share) over (partition by lang) as q from medians),
        totals as (select lang as ref, sum(letters) as total from measured where lang is not null group by lang),
        spoken as (select r, w, count(*) as n from (select r, unnest(ls) as w from docs) group by r, w),
        often as (
            select ref, w, n / total as q from (select lang as ref, w, sum(n) as n from spoken join docs using (r) where lang is not null group by all) join totals using (ref)
            qualify count(*) over (partition by ref order by n desc range between unbounded preceding and current row) <= 32
        ),
        common as (select ref, sum(q) as common from often group by ref),
        pairs as (select r, coalesce(lang, ref) as ref from measured join totals on lang is null or lang = ref),
        class_parts as (
            select r, ref, p, q from (select r, ref, unnest(range(1, 7)) as b, unnest(bins) / greatest(chars, 1) as p from pairs join measured using (r))
            join shares using (ref, b)
        ),
        class_js as (
            select r, ref, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + q * log2(2 * q / (p + q))) / 2 as js from class_parts group by r, ref
        ),
        word_parts as (
            select r, ref, sum(n / letters) as p, sum(q) as q, sum(n / letters * log2(2 * (n / letters) / (n / letters + q)) + q * log2(2 * q / (n / letters + q))) / 2 as js
            from pairs join spoken using (r) join often using (ref, w) join measured using (r) group by r, ref
        ),
        word_js as (
            select r, ref, coalesce(js, 0) + greatest(common - coalesce(q, 0), 0) / 2
                + case when p_left > 0 then p_left * log2(2 * p_left / (p_left + q_left)) / 2 else 0 end + case when q_left > 0 then q_left * log2(2 * q_left / (p_left + q_left)) / 2 else 0 end as js
            from (select *, greatest(1 - coalesce(p, 0), 0) as p_left, greatest(1 - common, 0) as q_left from pairs join common using (ref) left join word_parts using (r, ref))
        ),
        fits as (
            select r, bool_or(total < 1000 or (chars < 200 or class_js.js <= 0.18 * 0.18 + 5 / (8 * ln(2) * chars))
                and (letters < 50 or word_js.js <= 0.3 * 0.3 + 32 / (8 * ln(2) * letters))) as fits
            from pairs join totals using (ref) join measured using (r) left join class_js using (r, ref) left join word_js using (r, ref) group by r
        )
        select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
            n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(fits, true) as kept
        from measured left join fits using (r)
    """,
}
