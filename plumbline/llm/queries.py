"""One registered query per operator, over its whole table, and the check SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from plumbline.llm import alignment_counts, anchors, decontaminate, licenses, lm, neardup, pseudonyms, quality, sentencepieces, shards, token_counts, token_files, turn_repair
from plumbline.llm.common import read_table


def documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def tokenizer(name: str = "piece_bpe_32k.model") -> bytes:
    """A public model; ``PLUMBLINE_TOKENIZERS`` may name another folder of models."""
    folder = os.environ.get("PLUMBLINE_TOKENIZERS")
    if folder:
        return token_counts.read_model(os.path.join(folder, name))
    import public_tokenizers

    return token_counts.read_model(public_tokenizers.path(name))


def op1_sentencepiece(spark, sf_dir):
    """Ids of every text and whether decoding gives the text back."""
    model = tokenizer()
    docs = documents(spark, sf_dir).select("doc_id", "text")
    back = sentencepieces.encode(docs, model, decoded="decoded")
    marked = F.regexp_replace("text", "\u2581", " ")
    return back.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.col("decoded").eqNullSafe(marked).alias("round_trip"),
    )


def op2_decontaminate(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", *decontaminate.digest(found))


def op3_shards(spark, sf_dir):
    placed = shards.shard(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_licenses(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licenses.matches(licenses.scan_licenses(docs, keep=["doc_id"]))


def op5_token_counts(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn(
        "n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    )
    counted = token_counts.token_counts(docs, tokenizer(), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


#: A fixed key, so that the query's rows can be compared; a corpus gets a secret one.
QUERY_KEY = "pseudonyms of the registered query"


def op6_pseudonyms(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, QUERY_KEY, found="n_values")


def op7_interpolated_lm(spark, sf_dir):
    return lm.scores(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_block_anchors(spark, sf_dir):
    found = anchors.remove_repeats(documents(spark, sf_dir), with_text=False)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op9_minhash(spark, sf_dir):
    found = neardup.near_duplicates(documents(spark, sf_dir))
    return found.withColumnRenamed("id", "doc_id")


def op10_divergence(spark, sf_dir):
    judged = quality.quality(documents(spark, sf_dir).select("doc_id", "text", "lang"), keep=["doc_id"])
    return judged.select("doc_id", "quality.*")


def op11_token_alignment(spark, sf_dir):
    """Groups and links of two tokenizations of every document, and the corpus-wide counts of the links."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    a, b = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    return alignment_counts.align(docs, a, b, keep=["doc_id"]).select("doc_id", "alignment.*")


def op12_turn_repair(spark, sf_dir):
    """Damaged conversations and their cheapest repairs."""
    rows = turn_repair.damage(read_table(spark, sf_dir, "conversations"))
    return turn_repair.repair(rows, copies="copies").conversations


def op13_token_files(spark, sf_dir):
    """Boundaries and checksums of all documents' ids, as read back from their files."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = token_files.documents_from_files(docs, tokenizer("word_bpe_49k.json"), end=2)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontaminate": op2_decontaminate,
    "op3_shards": op3_shards,
    "op4_licenses": op4_licenses,
    "op5_token_counts": op5_token_counts,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_interpolated_lm": op7_interpolated_lm,
    "op8_block_anchors": op8_block_anchors,
    "op9_minhash": op9_minhash,
    "op10_divergence": op10_divergence,
    "op11_token_alignment": op11_token_alignment,
    "op12_turn_repair": op12_turn_repair,
    "op13_token_files": op13_token_files,
}

_CLEAN = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def _crc32(text: str) -> str:
    """CRC-32 of plain text in SQL: each byte is mixed in, then eight steps of one bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    bit = "case when b >= 0 then xor(x, b) when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda x, b: {bit}), 4294967295)"


def _moved(state: str, cost: str, letters: str, lines: str) -> str:
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || {letters}, 'o': {state}.o || {lines}}} end"


def _least(*options: str) -> str:
    return "list_min([" + ", ".join(options) + "])"


def _repair_sql() -> str:
    """The repair by its definition: four states a conversation, turn after turn."""
    user, both, reply = "'user:' || chr(10)", "'user:' || chr(10) || 'assistant:' || chr(10)", "'assistant:' || chr(10)"
    opened = {
        "t0": "s0",
        "t1": "s1",
        "t2": _least("s2", *(_moved(s, "3", "'I'", user) for s in ("s0", "s1", "s3"))),
        "t3": _least("s3", _moved("s2", "3", "'I'", reply), *(_moved(s, "6", "'II'", both) for s in ("s0", "s1"))),
    }
    own, line = "more", "role || ':' || text || chr(10)"
    keep = lambda s, i: f"case when stays and initial = '{i}' then {_moved(s, own, chr(39) + 'K' + chr(39), line)} end"
    name = lambda s, r: f"case when stays then {_moved(s, own + ' + 3', chr(39) + 'R' + chr(39), repr(r + ':') + ' || text || chr(10)')} end"
    gone = lambda s: _moved(s, "4", "'D'", "''")
    done = {
        "s0": gone("t0"),
        "s1": _least(gone("t1"), keep("t0", "s")),
        "s2": _least(gone("t2"), *(f(s, x) for s in ("t0", "t1", "t3") for f, x in ((keep, "u"), (name, "user")))),
        "s3": _least(gone("t3"), keep("t2", "a"), name("t2", "assistant")),
    }
    ends = _least("s0", "s3", _moved("s2", "3", "'I'", reply), _moved("s1", "6", "'II'", both))
    listed = lambda d: ", ".join(f"{v} as {k}" for k, v in d.items())
    none = "cast(null as struct(c bigint, a varchar, o varchar))"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind from conversations),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy from given where kind != 0),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
    rtrim(text, {blanks}) as body, left(role, 1) as initial from damaged),
turns as (
  select *, body = '' as blank, body != '' and again as duplicate,
    body != '' and not again and right(body, 1) not in ('.', '!', '?') as truncated,
    coalesce(lag(initial) over (partition by conv_id order by i) || initial not in ('su', 'ua', 'au'), false) as illegal from ordered),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank,
    count_if(duplicate) as duplicate, count_if(truncated) as truncated, count_if(illegal) as illegal, count(*) as n from turns group by conv_id),
steps as (select conv_id, i, role, text, initial, not blank and not duplicate as stays, case when truncated then 3 else 0 end as more from turns),
run as (
  select conv_id, n, cast(0 as bigint) as i, {{'c': cast(0 as bigint), 'a': '', 'o': ''}} as s0, {none} as s1, {none} as s2, {none} as s3 from counts
  union all
  select conv_id, n, i, {listed(done)} from (
    select r.conv_id, r.n, s.i, s.role, s.text, s.initial, s.stays, s.more, {listed(opened)}
    from run r join steps s on s.conv_id is not distinct from r.conv_id and s.i = r.i + 1)),
ends as (select conv_id, {ends} as e from run where i = n),
named as (select distinct conv_id from conversations)
select named.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank,
  cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
  cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(e.c, 0) as bigint) as cost, coalesce(e.a, '') as audit,
  sha256(coalesce(left(e.o, length(e.o) - 1), '')) as repaired_sha256
from named left join counts on counts.conv_id is not distinct from named.conv_id
  left join ends on ends.conv_id is not distinct from named.conv_id"""


SQL = {
    "op12_turn_repair": _repair_sql(),
    "op2_decontaminate": f"""
with d as (select doc_id, {_CLEAN.format("coalesce(text, '')")} as w from documents),
b as (select item_id, {_CLEAN.format("text")} as w from benchmark where text is not null),
passages as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as x
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
places as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as x
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from d cross join (select distinct n from passages) where len(w) >= n)),
hits as (select doc_id, i, n, item_id from places join passages using (x, n)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (
  select doc_id, count(distinct item_id) as n_items,
    array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as names from hits group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
    "op8_block_anchors": r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, unnest(range(1, greatest(len(w) - 11, 1))) as i, w from words),
hashed as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as x from windows),
least as (select x, min(doc_id) as first from hashed group by x),
gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as i from hashed join least using (x) where doc_id > first),
lost as (select doc_id, list(i) as g, count(*) as n from gone group by doc_id)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed,
  sha256(array_to_string(case when n is null then w
    else list_transform(list_filter(range(1, len(w) + 1), lambda k: not list_contains(g, k)), lambda k: w[k]) end, ' ')) as kept_sha256
from words left join lost using (doc_id)""",
    "op9_minhash": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents where text is not null),
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s
  from words),
classes as (select min(doc_id) as id, s, len(s) as n from sets where len(s) > 0 group by s),
parts as (select id, n, unnest(s) as x from classes),
pairs as (
  select a.id as a, b.id as b, count(*) as i, any_value(a.n) as na, any_value(b.n) as nb
  from parts a join parts b on a.x = b.x and a.id < b.id group by a.id, b.id),
links as (select a, b from pairs where 100 * i >= 85 * (na + nb - i)),
hops as (select a, b from links union all select b, a from links),
reach(id, component) as (
  select id, id from classes union select b, component from reach join hops on reach.id = hops.a),
home as (select id, min(component) as component from reach group by id)
select d.doc_id, coalesce(len(s.s), 0) as n_shingles, coalesce(h.component, d.doc_id) as component_id,
  d.doc_id = coalesce(h.component, d.doc_id) as kept
from documents d left join sets s using (doc_id)
  left join (select c.s, component from classes c join home using (id)) h on s.s = h.s""",
}
