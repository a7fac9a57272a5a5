"""The operators of this subpackage as queries over the shared tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.llm.common import fresh_path, table
from utterscope.llm.conversation_repair import damaged, repair_digests
from utterscope.llm.exact_dedup import exact_dedup
from utterscope.llm.lexical_search import search
from utterscope.llm.license_scan import scan_licenses
from utterscope.llm.line_dedup import dedup_lines
from utterscope.llm.mixing import mix
from utterscope.llm.near_dedup import near_dedup
from utterscope.llm.packing import pack
from utterscope.llm.secret_scan import scan_secrets
from utterscope.llm.token_files import read_token_files, token_digests, write_token_files
from utterscope.llm.toxicity import score_documents
from utterscope.llm.vector_dedup import vector_dedup
from utterscope.llm.warc import round_trip


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        F.octet_length("record").cast("long").alias("record_bytes"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), percent=85).drop("keeper")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedule, _ = mix(table(spark, sf_dir, "documents"))
    return schedule.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_digests(damaged(conversations), conversations)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(read_token_files(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_warc": op6_warc,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_vector_near_dedup": op8_vector_near_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_source_mix": op10_source_mix,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_files": op13_token_files,
}



def _walked() -> str:
    """The repair in SQL: from row to row the best (cost, audit, text) of each of the four states."""

    def then(state: str, cost: str, letter: str, line: str = "''") -> str:
        said = f"r.{state}.t" if letter == "D" else f"r.{state}.t || chr(10) || {line}"
        return f"case when r.{state} is not null then {{'c': r.{state}.c + {cost}, 'a': r.{state}.a || '{letter}', 't': {said}}} end"

    def stays(state: str, initial: str, new: str | None) -> list[str]:
        kept = f"case when not gone and i = '{initial}' then {then(state, 'late', 'K', 'line')} end"
        given = f"case when not gone then {then(state, '1 + late', 'R', f"'{new}:' || text")} end"
        return [kept, given] if new else [kept]

    reached = {
        "s0": [then("s0", "2", "D")],
        "s1": [then("s1", "2", "D"), *stays("s0", "s", None)],
        "s2": [then("s2", "2", "D"), *(x for s in ("s0", "s1", "s3") for x in stays(s, "u", "user"))],
        "s3": [then("s3", "2", "D"), *stays("s2", "a", "assistant")],
    }
    step = ", ".join(f"list_min([{', '.join(of)}]) as {name}" for name, of in reached.items())
    user, both = then("@", "5", "I", "'user:'"), then("@", "10", "II", "'user:' || chr(10) || 'assistant:'")
    answer = then("@", "5", "I", "'assistant:'")
    two = ", ".join(["r.s2", *(user.replace("@", s) for s in ("s0", "s1", "s3"))])
    three = ", ".join(["r.s3", answer.replace("@", "s2"), *(both.replace("@", s) for s in ("s0", "s1"))])
    return f"""
      with recursive bits as (
        select i::bigint as b, i::bigint as c, 0 as k from range(256) as r(i)
        union all
        select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
      crc as (select list(c order by b) as t from bits where k = 8),
      keyed as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
          list_prepend(4294967295, [ord(x)::bigint for x in string_split(
            concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')), '')]) as bytes
        from conversations),
      drawn as (
        select conv_id, turn, role, text, xor(list_reduce(bytes,
          lambda acc, x : xor(acc >> 8, t[((xor(acc, x)) & 255) + 1])), 4294967295) % 20 as draw
        from keyed, crc),
      kept as (
        select conv_id, turn, case when draw = 4 then 'user' else role end as role,
          case draw when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
        from drawn, (select unnest([1, 2]) as copy) as copies where draw <> 0 and (copy = 1 or draw = 3)),
      ordered as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
          trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as bare
        from kept),
      judged as (
        select *, role[1] as i, concat(role, ':', text) as line, bare = '' as blank,
          bare <> '' and row_number() over (partition by conv_id, role, text order by n) > 1 as again,
          bare[-1] not in ('.', '!', '?') as cut,
          concat(lag(role[1]) over (partition by conv_id order by n), role[1]) as pair
        from ordered),
      faults as (
        select *, blank or again as gone, case when not blank and not again and cut then 5 else 0 end as late,
          not blank and not again and cut as truncated
        from judged),
      walk as (
        select conv_id, 0::bigint as n, {{'c': 0::bigint, 'a': '', 't': ''}} as s0,
          case when false then {{'c': 0::bigint, 'a': '', 't': ''}} end as s1,
          {{'c': 5::bigint, 'a': 'I', 't': chr(10) || 'user:'}} as s2,
          {{'c': 10::bigint, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} as s3
        from (select distinct conv_id from conversations) as ids
        union all
        select r.conv_id, r.n, r.s0, r.s1, list_min([{two}]), list_min([{three}])
        from (
          select r.conv_id, f.n, {step}
          from walk as r join faults as f on f.conv_id = r.conv_id and f.n = r.n + 1) as r),
      counted as (
        select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (blank) as blank,
          count(*) filter (again) as duplicate, count(*) filter (truncated) as truncated,
          count(*) filter (n > 1 and pair not in ('su', 'ua', 'au')) as illegal, max(n) as n
        from faults group by conv_id),
      ended as (
        select w.conv_id, list_min([w.s0, w.s3]) as best from walk as w left join counted as c on c.conv_id = w.conv_id
        where w.n = coalesce(c.n, 0))
      select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
        coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit,
        sha256(substring(best.t, 2)) as repaired_sha256
      from ended as e left join counted as c on c.conv_id = e.conv_id
    """


_SEARCH_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = {
    "op12_lexical_search": f"""
      with docs as (select row_number() over () as row, doc_id, {_SEARCH_TERMS} as terms from documents),
      sizes as (select row, doc_id, len(terms)::bigint as n from docs where len(terms) > 0),
      whole as (select count(*)::bigint as docs, sum(n)::bigint as terms from sizes),
      asked as (
        select item, item_id, term, count(*) as often
        from (select row_number() over () as item, item_id, unnest({_SEARCH_TERMS}) as term from benchmark) as b
        group by item, item_id, term),
      held as (
        select row, term, count(*)::bigint as tf from (select row, unnest(terms) as term from docs) as d
        where term in (select term from asked) group by row, term),
      weights as (
        select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w
        from held, whole group by term),
      scores as (
        select item, item_id, row, doc_id,
          sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms)))))::bigint as score
        from asked join held using (term) join weights using (term) join sizes using (row), whole
        group by item, item_id, row, doc_id)
      select item_id, rank::integer as rank, doc_id, score
      from (select *, row_number() over (partition by item order by score desc, doc_id) as rank from scores where score > 0) as r
      where rank <= 20
    """,
    "op11_conversation_repair": _walked(),
    "op2_line_dedup": """
      with lines as (
        select doc_id, row, unnest(string_split(coalesce(text, ''), chr(10))) as line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as position
        from (select *, row_number() over () as row from documents)),
      keys as (
        select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
        from lines),
      owners as (
        select key, max(doc_id) as owner from keys where length(key) >= 20
        group by key having count(distinct doc_id) >= 3)
      select doc_id, count(*) as n_lines, count(*) filter (owner <> doc_id) as n_dropped,
        sha256(coalesce(string_agg(line, chr(10) order by position)
          filter (owner is null or owner = doc_id), '')) as kept_sha256
      from keys left join owners using (key) group by row, doc_id
    """,
    "op4_exact_dedup": """
      select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
        doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
      from documents window same as (partition by coalesce(text, ''))
    """,
    "op6_warc": """
      with named as (
        select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
          replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') as url,
          case when strlen(coalesce(html, '')) >= 1000 and page_id < max(page_id) over same
               then max(page_id) over same end as refers_to
        from pages window same as (partition by coalesce(html, ''))),
      bodies as (
        select *, refers_to is not null as again, concat('HTTP/1.1 200 OK##Content-Type: text/html; charset=utf-8##',
          'Content-Length: ', payload_bytes, '####') as http
        from named)
      select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type,
        refers_to, strlen(concat('WARC/1.1##WARC-Type: ', case when again then 'revisit' else 'response' end,
          '##WARC-Record-ID: <urn:uuid:', repeat('x', 36), '>##WARC-Date: 2024-01-01T00:00:00Z##WARC-Target-URI: ', url,
          '##WARC-Payload-Digest: sha1:', payload_digest, '##',
          case when again then concat(
            'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest##WARC-Refers-To: <urn:uuid:',
            repeat('x', 36), '>##X-Refers-To-Page: ', refers_to, '##') else '' end,
          'X-Page: ', page_id, '##Content-Type: application/http; msgtype=response##Content-Length: ',
          strlen(http) + case when again then 0 else payload_bytes end, '####', http, '####'))
          + case when again then 0 else payload_bytes end as record_bytes
      from bodies
    """,
}
