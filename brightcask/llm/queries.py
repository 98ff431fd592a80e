"""The registered queries, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightcask.llm.common import documents
from brightcask.llm.exact_dedup import exact_duplicates
from brightcask.llm.fill_in_middle import digests as fill_in_middle
from brightcask.llm.lexical_search import rank
from brightcask.llm.line_quality import judge
from brightcask.llm.mixing import mix
from brightcask.llm.ngram_lm import score as score_texts
from brightcask.llm.packing import pack
from brightcask.llm.pii import find as find_personal
from brightcask.llm.relative_lz import remove_repeats
from brightcask.llm.simhash import near_groups
from brightcask.llm.suffix_sort import remove_repeats as remove_repeated_bytes
from brightcask.llm.token_counts import token_counts
from brightcask.llm.toxicity import judge as judge_toxicity


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op9_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_deleted_interpolation": op3_deleted_interpolation,
    "op4_line_frequency": op4_line_frequency,
    "op5_pii_crf": op5_pii_crf,
    "op6_toxicity": op6_toxicity,
    "op7_relative_lz": op7_relative_lz,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_sort": op9_suffix_sort,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
               doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
        from t""",
    "op4_line_frequency": r"""
        with d as (select doc_id, coalesce('=' || source, '') as host, coalesce(text, '') as text from documents),
        w as (select doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
        l as (select doc_id, host, text, unnest(string_split(text, chr(10))) as line from d),
        l2 as (select *, lower(line) as low, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l),
        k as (select *, regexp_replace(array_to_string(regexp_extract_all(low, '[^\x20\x09-\x0D]+'), ' '), '[0-9]', '0', 'g') as key from l2 where n > 0),
        hosts as (select host, count(distinct text) as host_docs from d group by host),
        common as (select host, key from k join hosts using (host) group by host, key, host_docs having count(distinct text) > 10 and count(distinct text) > least(0.05 * host_docs, 100)),
        lost as (select doc_id, sum(n)::bigint as n_lost_words from k semi join common using (host, key) group by doc_id),
        dup as (select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines from k group by doc_id),
        pos as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) > 2),
        win as (select doc_id, i, words[i:i + 2] as win from pos),
        again as (select doc_id, i from win qualify count(*) over (partition by doc_id, win) > 1),
        rep as (select doc_id, count(distinct i + o) as n_repeat_words from again, (select unnest([0, 1, 2]) as o) group by doc_id),
        m as (select doc_id, len(words)::bigint as n_words, coalesce(length(array_to_string(words, '')), 0)::bigint as word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
                     coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lost_words, 0) as n_lost_words
              from w left join dup using (doc_id) left join rep using (doc_id) left join lost using (doc_id))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
               n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_lost_words <= 0.5 * n_words as kept
        from m""",
    "op7_relative_lz": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
        starts as (select doc_id, unnest(range(1, len(words) - 11)) as i, words from w where len(words) > 12),
        win as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as win from starts),
        dup as (select doc_id, i from win qualify doc_id > min(doc_id) over (partition by win)),
        gone as (select distinct doc_id, i + o as i from dup, (select unnest(range(13)) as o)),
        each_word as (select doc_id, unnest(range(1, len(words) + 1)) as i, unnest(words) as word from w),
        kept as (select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n from each_word anti join gone using (doc_id, i) group by doc_id)
        select w.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
        from w left join kept using (doc_id)""",
    "op12_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id::varchar) as sha from documents),
        u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, [('0x' || sha[8 * i + 1:8 * i + 8])::bigint for i in [0, 1, 2, 3]] as h from d),
        c as (select *, len(units) as n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as z,
                     case when text = '' or regexp_matches(text, '<[PSM]>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from u),
        p as (select *, coalesce(array_to_string(units[1:a], ''), '') as pre, coalesce(array_to_string(units[a + 1:z], ''), '') as mid, coalesce(array_to_string(units[z + 1:], ''), '') as suf from c)
        select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
               sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
               sha256(text) as restored_sha256
        from p""",
    "op13_lexical_search": r"""
        with words as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
        d as (select doc_id, w, len(w) as n from words where len(w) > 0),
        total as (select count(*) as docs, sum(n)::bigint as words from d),
        each as (select doc_id, n, unnest(w) as term from d),
        tf as (select doc_id, n, term, count(*) as tf from each group by all),
        items as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from tf, total group by term, docs),
        hits as (select item_id, doc_id, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words)))) as gain
                 from items join tf using (term) join weights using (term), total),
        scores as (select item_id, doc_id, sum(gain)::bigint as score from hits group by all having sum(gain) > 0)
        select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer as rank, doc_id, score from scores qualify rank <= 20""",
}
