"""The registered queries: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hygeia.llm.chat import link_tool_calls
from hygeia.llm.common import Scratch
from hygeia.llm.html_crf import main_text
from hygeia.llm.minhash import near_classes
from hygeia.llm.mixing import mix_sources, text_digest, word_count
from hygeia.llm.packing import pack_documents
from hygeia.llm.quality import BASE, judge
from hygeia.llm.repair import damaged, repaired_digests
from hygeia.llm.sharding import hilbert_shards
from hygeia.llm.sketch import edited_fingerprints, fingerprint, resemblance
from hygeia.llm.spelling import spelling_variants
from hygeia.llm.sql import CONVERSATION_REPAIR, SPELLING_VARIANTS
from hygeia.llm.substring import substring_dedup
from hygeia.llm.subwords import decode, encode
from hygeia.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *BASE, "base_failed", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = Scratch(spark, "mixing").table(docs.select("doc_id", "source", word_count().alias("size"), text_digest().alias("digest")), "sized")
    out = mix_sources(sized, F.col("size"), tie=F.col("digest"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


def op10_bottom_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint("sketch").alias("fingerprint"),
                      fingerprint("edited_sketch").alias("edited_fingerprint"),
                      resemblance("sketch", "edited_sketch").alias("near_edited"),
                      resemblance("sketch", "next_sketch").alias("near_next"))


#: The tools of the derived call log.
TOOLS = {
    "search": {"limit": ("integer", False, 1, 200), "query": ("string", True, None, None)},
    "summarise": {"text": ("string", True, None, None), "words": ("integer", True, 1, 150)},
    "translate": {"strict": ("boolean", False, None, None), "text": ("string", True, None, None)},
}


def derived_tool_log(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) from chat turns: each assistant turn is a call whose arguments hold its whole text, the user
    turn after it is the result. A call refers to the call at half its turn; every 13th call lacks a
    parameter or breaks its JSON, so all paths of the operator have rows."""
    c = conversations.select("conv_id", "turn", "role", "text")
    call = lambda turn: F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), turn)
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    pick = F.col("turn") % 3
    odd = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(13))
    text = F.expr("substr(to_json(struct(coalesce(text, '') as t)), 6, length(to_json(struct(coalesce(text, '') as t))) - 6)")
    search = F.concat(F.lit('{ "query": '), text, F.lit(', "limit": '), words, F.lit(" }"))
    summarise = F.concat(F.lit('{"words":'), words, F.when(odd == 1, F.lit("")).otherwise(F.concat(F.lit(',  "text":'), text)), F.lit("}"))
    translate = F.concat(F.lit('{"text": '), text, F.lit(', "strict": '), F.when(odd == 2, F.lit('"yes"')).otherwise(F.lit("true")),
                         F.when(odd == 3, F.lit("")).otherwise(F.lit("}")))
    half = F.expr("2 * (turn div 4) + 1")
    calls = c.where("role = 'assistant'").select(
        "conv_id", call(F.col("turn")).alias("call_id"), "turn",
        F.element_at(F.lit(sorted(TOOLS)), (pick + 1).cast("int")).alias("name"),
        F.when(pick == 0, search).when(pick == 1, summarise).otherwise(translate).alias("arguments"),
        F.when(half < F.col("turn"), F.array(call(half))).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = c.where("role = 'user' and turn > 0").select(
        "conv_id", call(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_tool_calls(*derived_tool_log(_table(spark, sf_dir, "conversations")), TOOLS)
    return out.select("conv_id", "call_id", "turn", "name", "result_turn", "n_results", "level", "position",
                      F.array_join("errors", "; ").alias("errors"), "record")


def op6_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "timestamp", "intact")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"),
                      F.col("longest").alias("longest_repeat"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repaired_digests(conversations, damaged(conversations))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), spoil=97)


def pieces_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces_model()
    out = decode(encode(_table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_source_mixing": op3_source_mixing,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op10_bottom_k_sketch": op10_bottom_k_sketch,
    "op5_tool_call_linking": op5_tool_call_linking,
    "op6_crf_main_text": op6_crf_main_text,
    "op9_warc_index_merge": op9_warc_index_merge,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_sentencepiece": op13_sentencepiece,
}

# ---- DuckDB SQL ---------------------------------------------------------------
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, {words} as w from documents),
tok as (select r, doc_id, unnest(w) as x, unnest(range(len(w))) as i from d),
gram as (select r, i, x || chr(10) || lead(x) over o || chr(10) || lead(x, 2) over o as g from tok window o as (partition by r order by i)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from gram where g is not null) where c > 1),
rep as (select r, count(distinct i + k) as n from twice, range(3) s(k) group by r),
line as (select r, unnest(string_split(t, chr(10))) as l from d),
lines as (
  select r, count(*) as n, count(*) - count(distinct l) as dup,
         count(*) filter (where l like '%...' or l like '%…') as open
  from line where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
freq as (select r, max(c) as most from (select r, x, count(*) as c from tok group by r, x) group by r),
shape as (
  select r, sum(length(x)) as chars, count(*) filter (where x like '%!') as marks,
         count(*) filter (where regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')) as letters from tok group by r),
s as (
  select d.doc_id, len(d.w) as n_words, coalesce(shape.chars, 0) as word_chars,
         length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(lines.dup, 0) as n_dup_lines,
         coalesce(rep.n, 0) as n_repeat_words, coalesce(lines.n, 0) as n_lines, coalesce(lines.open, 0) as n_open,
         coalesce(freq.most, 0) as most, coalesce(shape.marks, 0) as marks, coalesce(shape.letters, 0) as letters,
         length(regexp_replace(d.t, '[^A-Z]', '', 'g')) as up, length(regexp_replace(d.t, '[^a-z]', '', 'g')) as low
  from d left join rep using (r) left join lines using (r) left join freq using (r) left join shape using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not (base_failed or n_symbols > 0.3::double * n_words or word_chars::double / greatest(n_words, 1) < 2
            or word_chars::double / greatest(n_words, 1) > 14 or n_dup_lines > 0.4::double * n_lines
            or marks > 0.4::double * n_words or up > low or letters < 0.5::double * n_words or 4 * most > n_words
            or n_open > 0.5::double * greatest(n_lines, 1)) as kept
from f"""

_OP3 = r"""
with d as (
  select doc_id, source, len({words})::bigint as size, md5(coalesce(text, '')) as digest,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':11'), 1, 15))::bigint as k from documents),
per as (select source, sum(size)::bigint as source_size from d group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as rk, 3.0::double * source_size as cap from per),
weighed as (select *, [5.0, 2.0, 1.0][rk % 3 + 1]::double as w from ranked),
levels as (
  select *, cap / w as full_at,
         ((select sum(source_size) from per)::double - coalesce(sum(cap) over (order by cap / w, rk rows between unbounded preceding and 1 preceding), 0))
         / sum(w) over (order by cap / w, rk rows between current row and unbounded following) as lv
  from weighed),
chosen as (select coalesce(arg_min(lv, (full_at, rk)) filter (where lv <= full_at), 'infinity'::double) as lv from levels),
target as (select source, source_size, least(chosen.lv * w, cap) as target from levels, chosen),
placed as (
  select d.*, coalesce(sum(size) over (partition by source order by k, doc_id, size, digest rows between unbounded preceding and 1 preceding), 0) as before from d)
select p.doc_id, p.size, t.source_size, t.target,
       (case when t.source_size > 0 then p.size * floor(t.target / t.source_size) + greatest(0, least(p.size,
          floor(t.target - floor(t.target / t.source_size) * t.source_size + 0.5) - p.before)) else 0 end)::bigint as taken
from placed p join target t on p.source is not distinct from t.source"""


def _op7_sql(width: int = 13, levels: int = 12) -> str:
    """Level 0 settles what is removed; each further level keeps the documents with a window of twice the length
    that another document holds."""
    parts = [f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
g as (select r, doc_id, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) as h
      from (select r, doc_id, w, unnest(range(1, len(w) - {width - 2})) as i from d where len(w) >= {width})),
seen as (select h, min(doc_id) as low, max(doc_id) as high from g group by h),
later as (select r, i from g join seen using (h) where low < doc_id),
gone as (select distinct r, i + k as i from later, range({width}) s(k)),
tok as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
kept as (select r, string_agg(x, ' ' order by i) as t from tok anti join gone using (r, i) group by r),
lost as (select r, count(*) as n from gone group by r),
l0 as (select distinct r from g join seen using (h) where low <> high)"""]
    for k in range(1, levels):
        n = width * 2**k
        parts.append(f"""l{k} as (select distinct r from (select r, min(doc_id) over (partition by h) as low, max(doc_id) over (partition by h) as high
  from (select r, doc_id, md5(array_to_string(w[i:i + {n - 1}], ' ')) as h
        from (select r, doc_id, w, unnest(range(1, len(w) - {n - 2})) as i from d semi join l{k - 1} using (r) where len(w) >= {n})))
  where low <> high)""")
    every = " union all ".join(f"select r, {width * 2**k} as n from l{k}" for k in range(levels))
    return ",\n".join(parts) + f""",
top as (select r, max(n) as n from ({every}) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(lost.n, 0)::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256,
       coalesce(top.n, 0)::bigint as longest_repeat
from d left join kept using (r) left join lost using (r) left join top using (r)"""


_OP9 = r"""
with p as (select page_id, url, octet_length(encode(coalesce(html, '')))::bigint as n, sha1(coalesce(html, '')) as h from pages),
last as (select h, max(page_id) as top from p where n >= 1000 group by h)
select page_id, n as payload_bytes, h as payload_digest,
       case when n >= 1000 and top <> page_id then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and top <> page_id then top end as refers_to, url,
       strftime(timestamp '2024-01-01 00:00:00' + to_seconds((coalesce(page_id, 0) % 1000000000 + 1000000000) % 1000000000), '%Y%m%d%H%M%S') as timestamp, true as intact
from p left join last using (h)"""

#: What SQL can't express (tokenizers, samples, fields, engine-own hashes) is tested against plain versions in tests/llm.
SQL: dict[str, str] = {
    "op1_quality_rules": _OP1.replace("{words}", _WORDS),
    "op3_source_mixing": _OP3.replace("{words}", _WORDS),
    "op7_substring_dedup": _op7_sql(),
    "op9_warc_index_merge": _OP9,
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op12_spelling_variants": SPELLING_VARIANTS,
}
