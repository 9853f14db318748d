"""Registered queries of the training-data operators: op -> thin query, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.llm import bwt_dedup, collocation, cross_parsing, decontam, packing, pitman_yor, preference, quality, ranked_search, simhash, token_files, toxicity, url_filter
from pitlane.llm.common import land, scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document into token files, then read lengths, starts and checksums back."""
    path = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.token_digests(spark, path)


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2_SQL = f"""
with dw as (
  select doc_id, {_WORDS} as w from documents
), bw as (
  select item_id, {_WORDS} as w from benchmark
), win as (
  select distinct item_id, least(10, len(w)) as n, w[i:i + least(10, len(w)) - 1] as g
  from bw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as t(i) where len(w) > 0
), grams as (
  select doc_id, i, n, w[i:i + n - 1] as g from dw, (select distinct n from win), unnest(range(1, len(w) - n + 2)) as t(i)
), hits as (
  select doc_id, i, n, item_id from grams join win using (n, g)
), covered as (
  select doc_id, count(distinct i + j) as n_hit from (select distinct doc_id, i, n from hits), unnest(range(0, n)) as t(j) group by 1
), items as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hits) group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (doc_id) left join items using (doc_id)
"""


@query("op2_positional_index", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in an occurrence of a ten-word benchmark window."""
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    found = decontam.contamination(index, table(spark, sf_dir, "benchmark"), size=10)
    return found.withColumn("n_hit", decontam.covered()).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
), win as (
  select doc_id, i, substr(h, 2 * i + 1, 100) as s from d, unnest(range(0, n - 49)) as t(i)
), again as (
  select doc_id, i from win qualify doc_id > min(doc_id) over (partition by s)
), step as (
  select doc_id, i, coalesce(i > lag(i) over mine + 50, true) as new, lead(i) over mine as nxt from again window mine as (partition by doc_id order by i)
), numbered as (
  select doc_id, i, least(coalesce(nxt - i, 50), 50) as adds, sum(new::int) over (partition by doc_id order by i) as run from step
), runs as (
  select doc_id, run, min(i) as a, max(i) + 50 as b, sum(adds) as bytes from numbered group by 1, 2
), keep as (
  select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head, max(b) as tail
  from (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from runs) join d using (doc_id) group by 1
)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) as kept_sha256
from d left join keep using (doc_id)
"""


@query("op3_bwt_merge", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50-byte strings of documents with smaller ids."""
    return bwt_dedup.repeats(table(spark, sf_dir, "documents"), length=50)


_SP = r"[\x20\x09-\x0D]"
_RISK, _DELTA = 0.02, 0.05
_RULES = ", ".join(f"('{r}', [{', '.join(f'{c}::double' for c in g)}])" for r, g in quality.LADDERS.items())

#: The binomial tail is summed from lgamma terms here, from a recurrence in the operator.
OP4_SQL = f"""
with d as (
  select doc_id, lang, coalesce(text, '') as text from documents
), w as (
  select doc_id, lang, text, list_filter(regexp_split_to_array(text, '{_SP}+'), lambda x: x <> '') as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d
), win as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from w, unnest(range(1, len(w) - 3)) as t(i)
), dup as (
  select doc_id, i from win qualify count(*) over (partition by doc_id, s) > 1
), cov as (
  select doc_id, count(distinct i + j) as n from dup, unnest(range(0, 5)) as t(j) group by 1
), f as (
  select doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
         len(l) as n_lines, len(list_distinct(w)) as n_distinct
  from w left join cov using (doc_id)
), b as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, greatest(n_words, 1)::double as nw from f
), rules(rule, grid) as (values {_RULES}
), m as (
  select doc_id, lang, base_failed, rule, grid, case rule
    when 'symbols_per_word' then n_symbols / nw when 'dup_line_share' then n_dup_lines / greatest(n_lines, 1)::double
    when 'repeat_share' then n_repeat_words / nw when 'same_word_share' then 1 - n_distinct / nw
    when 'mean_word_chars' then word_chars / nw else -word_chars / nw end as v
  from b, rules
), placed as (
  select doc_id, lang, base_failed, min(len(list_filter(grid, lambda c: v <= c))) as step from m group by 1, 2, 3
), held as (
  select lang, step, good from placed join (select doc_id, min(quality) as good from labels where quality is not null group by 1) using (doc_id) where not base_failed
), steps as (
  select lang, step, sum(sum((good = 1)::int)) over upto as k, sum(sum((good <> 1)::int)) over upto as bad, sum(sum((good = 1)::int)) over (partition by lang) as n
  from held group by 1, 2 window upto as (partition by lang order by step)
), p as (
  select {_RISK}::double as a, {_DELTA}::double / count(distinct coalesce('=' || lang, '-')) as level from steps
), limits as (
  select lang, coalesce(max(i) filter (tail <= level), -1) as most from (
    select lang, i, level, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(a) + (n - i) * ln(1 - a))) over (partition by lang order by i) as tail
    from (select distinct lang, n from steps where n > 0), p, unnest(range(0, ceil(n * a)::bigint + 1)) as t(i)
  ) group by 1
), best as (
  select s.lang, step from steps s join limits l on l.lang is not distinct from s.lang where step < {quality.STEPS} and k <= most and bad > k
  qualify row_number() over (partition by s.lang order by bad - k desc, step) = 1
), gone as (
  select doc_id from placed join best on best.lang is not distinct from placed.lang where placed.step <= best.step
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and doc_id not in (select doc_id from gone) as kept
from b
"""


@query("op4_risk_controlled_rules", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base features and the verdict of risk-controlled rules for every document."""
    featured = quality.with_features(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"])
    chosen = quality.cutoffs(featured, table(spark, sf_dir, "labels"), "lang", _RISK, _DELTA)
    out = quality.judge(featured, land(chosen, "cutoffs"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_pitman_yor")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and Pitman-Yor scores of every document; one document in seven is held out."""
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"), pitman_yor.held_out(7, 2))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, max_tokens=1024)


#: The rules that the query lists, and the pattern rules behind its own verdicts.
LISTED = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
PATTERNS = ["||spam-farm.", "||cheap-pills.", "||casino-win.", "||free-bets.", "||adult-x.", "||ads-track."]

OP7_SQL = f"""
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u
), rules(rule, rule_host, rule_path, verdict) as (values
  {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in LISTED)}
), d as (
  select distinct host, path from p
), best as (
  select host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from d join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by 1, 2
)
select page_id, p.host, p.path, rule,
       coalesce(verdict, case when regexp_matches(p.host || p.path, '^([^/]*[.])?({"|".join(x[2:].replace(".", "[.]") for x in PATTERNS)})') then 'block' else 'allow' end) as verdict
from p left join best on p.host = best.host and p.path = best.path
"""


@query("op7_url_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the listed rules first, then by the pattern rules."""
    rules = [url_filter.domain_rule(r, v) for r, v in LISTED] + [url_filter.Rule(x, "block", layer=1) for x in PATTERNS]
    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", F.when(F.col("layer") == 0, F.col("rule")).alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"))


@query("op8_bigru_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of one document in five are not learnt from."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.held_out(5, 0))


_RENDER = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"

OP9_SQL = f"""
with t as (
  select distinct conv_id as id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), last as (
  select id, max(turn) as turn, arg_max(text, (turn, text)) as text from t where role = 'assistant' and turn is not null group by 1
), r as (
  select distinct t.id, t.turn, role, case when role = 'assistant' and t.turn = last.turn then n.text else t.text end as text
  from t left join last using (id) left join last n on n.id = t.id + 1
  where role <> 'assistant' or last.turn is null or t.turn is distinct from last.turn or n.text is not null
), sides as (
  select 'a' as side, * from t union all select 'b', * from r
), differing as (
  select id, turn from sides group by 1, 2
  having coalesce(list(role || chr(0) || text order by role, text) filter (side = 'a'), []) <> coalesce(list(role || chr(0) || text order by role, text) filter (side = 'b'), [])
), cut as (
  select id, min(turn) as first from differing group by 1
), placed as (
  select sides.*, first is null or turn < first as shared, {_RENDER} as s, length('<|im_start|>' || role || chr(10)) as head from sides left join cut using (id)
)
select id as pair_id, count(distinct turn) filter (shared and side = 'a') as n_prompt_turns,
       sha256(coalesce(string_agg(s, '' order by turn, role, text) filter (shared and side = 'a'), '')) as prompt_sha256,
       sha256(coalesce(string_agg(s, '' order by turn, role, text) filter (not shared and side = 'a'), '')) as chosen_sha256,
       sha256(coalesce(string_agg(s, '' order by turn, role, text) filter (not shared and side = 'b'), '')) as rejected_sha256,
       coalesce(sum(length(s) - head) filter (not shared and side = 'a' and role = 'assistant'), 0)::bigint as chosen_loss_chars,
       coalesce(sum(length(s) - head) filter (not shared and side = 'b' and role = 'assistant'), 0)::bigint as rejected_loss_chars
from placed group by 1
"""


@query("op9_preference_pairs", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with the next one's last answer: prompt, completions and masks, as digests."""
    pairs = preference.format_pairs(*preference.answers_of_next(table(spark, sf_dir, "conversations")))
    chars = lambda mask: F.aggregate(mask, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return pairs.select(
        "pair_id", "n_prompt_turns", *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")),
        chars("chosen_mask").alias("chosen_loss_chars"), chars("rejected_mask").alias("rejected_loss_chars"),
    )


@query("op10_simhash_trie")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document (three-word shingles, three bits)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, budget=3).select("doc_id", "fingerprint", "component_id")


@query("op11_cross_parsing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing; one document in four is not learnt from."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", toxicity.held_out(4, 2))
    samples = cross_parsing.sample_languages(docs.filter(~F.col("held_out")))
    return cross_parsing.identify(docs, samples, keep=["doc_id", "held_out"])


OP12_SQL = f"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents
), w as materialized (
  select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from p
), total as (
  select lang, sum(len(w))::bigint as n from w group by 1
), f as materialized (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, any_value(w[i:i + m - 1]) as words, count(*)::bigint as a
  from w, unnest(range(1, 6)) as s(m), unnest(range(1, len(w) - m + 2)) as t(i) group by 1, 2, 3 having count(*) >= 100
), parts as materialized (
  select lang, m, phrase, a, k, array_to_string(words[1:k], ' ') as first, array_to_string(words[k + 1:], ' ') as rest from f, unnest(range(1, m)) as u(k)
), cuts as (
  select p.*, l.a as l, r.a as r, n, ((1000::hugeint * p.a::hugeint * n::hugeint) // (l.a::hugeint * r.a::hugeint))::bigint as score
  from parts p join total using (lang) join f l on l.lang = p.lang and l.phrase = p.first join f r on r.lang = p.lang and r.phrase = p.rest
), least as (
  select lang, m, phrase, any_value(a) as a, any_value(n) as n, arg_min(l, (score, k)) as l, arg_min(r, (score, k)) as r, min(score) as score from cuts group by 1, 2, 3
), kept as (
  select * from least x where not exists (
    select 1 from f y where y.lang = x.lang and y.a = x.a and y.m > x.m and contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= 2000
"""


@query("op12_pair_tiles", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to five words of every language."""
    return collocation.collocations(table(spark, sf_dir, "documents"), max_words=5, min_count=100, top=2000)


OP13_SQL = f"""
with t as (
  select doc_id, len(w)::bigint as n, w from (select doc_id, {_WORDS} as w from documents) where len(w) > 0
), total as (
  select count(*)::bigint as nd, sum(n)::bigint as nt from t
), tf as (
  select doc_id, n, term, count(*)::bigint as tf from t, unnest(w) as u(term) group by 1, 2, 3
), weights as (
  select term, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by 1
), q as (
  select distinct item_id, term from (select item_id, {_WORDS} as w from benchmark), unnest(w) as u(term)
), scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))))::bigint as score
  from q join tf using (term) join weights using (term), total group by 1, 2
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""


@query("op13_ranked_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), k=10)
