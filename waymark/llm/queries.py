"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, chat, dedup, fertility, langid, licenses, merkle, mixing, pieces, ranked, syncmers, token_files, urls
from waymark.llm._common import fresh_path, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents: three-word shingles, 85 per cent."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=3)


#: Links by counting shared shingles of every two texts that share any; equal sets are one node, so that closures stay small.
_OP1_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then cast([] as varchar[]) when len(w) < 3 then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')))) end as s from w),
kinds as (select s, min(doc_id) as node, len(s) as n from sets where len(s) > 0 group by s),
shingles as (select node, n, unnest(s) as x from kinds),
links as (select a.node as a, b.node as b from shingles a join shingles b on a.x = b.x and a.node < b.node and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.node, b.node having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
ways as (select a, b from links union select b, a from links),
reached as (select node, node as root from kinds union select ways.b, reached.root from reached join ways on ways.a = reached.node),
labels as (select node, min(root) as component from reached group by node)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles, coalesce(l.component, d.doc_id) as component_id, d.doc_id = coalesce(l.component, d.doc_id) as kept
from sets d left join kinds k on k.s = d.s left join labels l on l.node = k.node
"""


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of documents."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.fit(docs))


#: A vocabulary with byte fallback, and a byte-level one for many languages.
FERTILITY_VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")


def op4_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and tokeniser fertility of every text of documents, in two vocabularies, with limits learned from labels."""
    first, second = map(public_tokenizers.path, FERTILITY_VOCABULARIES)
    return fertility.measure_documents(table(spark, sf_dir, "documents"), first, second=second, labels=table(spark, sf_dir, "labels"), lang_col="lang")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every text of documents to token files and read them back."""
    folder = fresh_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.read_token_files(spark, folder)


def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of documents and of its edited text, and their likeness."""
    return syncmers.compare_edited(table(spark, sf_dir, "documents"))


#: Domains of the mixing queries: sources by their number modulo three.
MIX_WEIGHTS = {"domain": {"domain0": 3.0, "domain1": 2.0, "domain2": 1.0}, "lang": {"en": 4.0, "de": 2.0}, "source": {}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.9, 2, 17


def mix_domain() -> Column:
    """The domain of a row of documents."""
    return F.expr("concat('domain', try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 3)")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for nine tenths of all tokens, two epochs at most, at target weights."""
    rows = mixing.sizes(table(spark, sf_dir, "documents"), mix_domain())
    return mixing.mix_documents(rows, mixing.mix_plan(rows, MIX_SHARE, MIX_EPOCHS, MIX_WEIGHTS, MIX_SEED), MIX_SEED)


def _filled(name: str, nodes: str, parents: str, child: str) -> str:
    """SQL of one level of water-filling: name(parents, child, budget) from nodes(parents, child, capacity, weight, total)."""
    by = f"partition by {parents}, 1" if parents else "partition by 1"
    key = f"{parents}, " if parents else ""
    return f"""
{name}_steps as (
  select *, (total - coalesce(sum(capacity) over (o rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over ({by}) - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0)) as level
  from {nodes} window o as ({by} order by capacity / weight, {child})),
{name}_level as (
  select *, min(case when capacity > level * weight then {{'r': capacity / weight, 'c': {child}, 'l': level}} end) over ({by}).l as final
  from {name}_steps),
{name} as (select {key}{child}, case when final is null or capacity <= final * weight then cast(capacity as double) else final * weight end as budget from {name}_level)"""


def mix_sql(share: float = MIX_SHARE, epochs: int = MIX_EPOCHS) -> str:
    """DuckDB SQL of the documents that a mix of that share of the tokens takes, each so often at most."""
    return f"""
with rows_ as (
  select doc_id, coalesce('domain' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 3), 'unknown') as domain,
    coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as n_tokens
  from documents),
leaves as (select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens from rows_ where n_tokens > 0 group by all),
sized as (select *, tokens * {epochs} as capacity, cast(1 as double) as weight from leaves),
domains as (
  select domain, cast(sum(capacity) as bigint) as capacity,
    cast(case domain when 'domain0' then 3 when 'domain1' then 2 when 'domain2' then 1 else 1 end as double) as weight,
    (select floor(sum(tokens) * cast({share} as double)) from leaves) as total
  from sized group by domain),{_filled("top_", "domains", "", "domain")},
langs as (
  select domain, lang, capacity, weight, budget as total from (
    select domain, lang, cast(sum(capacity) as bigint) as capacity, cast(case lang when 'en' then 4 when 'de' then 2 else 1 end as double) as weight
    from sized group by domain, lang) join top_ using (domain)),{_filled("middle_", "langs", "domain", "lang")},
sources as (select domain, lang, source, capacity, weight, budget as total from sized join middle_ using (domain, lang)),{_filled("bottom_", "sources", "domain, lang", "source")},
plan as (
  select domain, lang, source, cast(floor(b.budget + 1e-6) as bigint) // tokens as epochs, cast(floor(b.budget + 1e-6) as bigint) % tokens as rest
  from leaves join bottom_ b using (domain, lang, source)),
hashed as (
  select *, md5(concat_ws('|', '{MIX_SEED}', cast(epochs as varchar), coalesce(cast(doc_id as varchar), ''))) as hash
  from rows_ join plan using (domain, lang, source) where n_tokens > 0),
placed as (
  select *, sum(n_tokens) over (partition by domain, lang, source order by hash range between unbounded preceding and current row)
    - sum(n_tokens) over (partition by domain, lang, source, hash) < rest as in_prefix
  from hashed)
select doc_id, domain, lang, source, n_tokens, cast(epochs + cast(in_prefix as int) as bigint) as copies, in_prefix
from placed where epochs + cast(in_prefix as int) > 0
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures in every text of documents."""
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every URL of pages by written rules and rules mined from the labelled ones."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.mine(pages, table(spark, sf_dir, "labels")))


def _url_sql(url: str) -> str:
    """SQL of a URL's host, path and distinct tokens."""
    rest = f"case when strpos({url}, '://') > 0 then substr({url}, strpos({url}, '://') + 3) else '' end"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""u as (select *, translate(regexp_extract(coalesce({rest}, ''), '^[^/?#]*'), '{upper}', '{lower}') as host, regexp_extract(coalesce({rest}, ''), '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(coalesce({url}, ''), '[?]([^#]*)', 1) as query from numbered),
  parts as (select *, string_split(host, '.') as p from u),
  tokens as (select n, page_id, host, path, case when host = '' then cast([] as varchar[]) else list_distinct(list_concat(['site:' || array_to_string(p[greatest(len(p) - 2, 1):], '.')],
      list_transform(list_filter(string_split_regex(host, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> ''), lambda x: 'host:' || x),
      list_transform(list_filter(string_split(regexp_replace(lower(path), '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), lambda x: 'path:' || x),
      list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^[^=]*')), lambda x: x <> ''), lambda x: 'key:' || x))) end as tokens from parts)"""


_OP9_SQL = f"""
with recursive numbered as (select *, row_number() over () as n from pages),
  {_url_sql("url")},
  bad as (select doc_id as id, max((coalesce(toxic, 0) = 1 or coalesce(quality, 1) = 0)) as bad from labels where doc_id is not null group by doc_id),
  items as (select t.n, t.tokens, bad from tokens t join bad on bad.id = t.page_id where bad or len(t.tokens) > 0),
  least_ as (select count(*) as rows_, greatest({urls.MIN_SUPPORT} * count(*), {urls.MIN_COUNT}) as least from items),
  unwanted as (select n, tokens from items where bad),
  often as (select tok, list(n order by n) as rows_ from (select n, unnest(tokens) as tok from items) q group by tok having count(*) >= (select least - 0.000001 from least_)),
  classes as (select tok, min(tok) over (partition by rows_) as rep from often),
  bad_reps as (select n, list_distinct(list(rep)) as reps from (select n, unnest(tokens) as tok from unwanted) q join classes using (tok) group by n),
  item_reps as (select n, bad, list_distinct(list(rep)) as reps from (select n, bad, unnest(tokens) as tok from items) q join classes using (tok) group by n, bad),
  singles as (select tok from (select unnest(reps) as tok from bad_reps) q group by tok having count(*) >= (select least - 0.000001 from least_)),
  sets as (
    select [tok] as x from singles
    union all
    select list_append(s.x, t.tok) as x from sets s join singles t on t.tok > s.x[len(s.x)] join bad_reps b on list_has_all(b.reps, list_append(s.x, t.tok)) group by list_append(s.x, t.tok) having count(*) >= (select least - 0.000001 from least_)),
  sure as (select x, sum(case when bad then 1 else 0 end) / cast(count(*) as double) as confidence from sets join item_reps on list_has_all(reps, x) group by x having sum(case when bad then 1 else 0 end) / cast(count(*) as double) >= {urls.MIN_CONFIDENCE}),
  mined as (select x, confidence from sure a where not exists (select 1 from sure b where len(b.x) < len(a.x) and list_has_all(a.x, b.x) and b.confidence >= a.confidence)),
  firsts as (select n, rep, min(tok) as tok from (select n, unnest(tokens) as tok from tokens) q join classes using (tok) group by n, rep),
  own as (select n, list(rep) as reps from firsts group by n),
  matched as (select o.n, m.confidence, m.x, unnest(m.x) as rep from own o join mined m on list_has_all(o.reps, m.x)),
  shown as (select n, confidence, x, list_sort(list(f.tok)) as toks from matched join firsts f using (n, rep) group by n, confidence, x),
  best as (select n, toks as x, confidence from shown qualify row_number() over (partition by n order by confidence desc, len(toks), toks) = 1),
  written as (select * from (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)}) r(h, p, v)),
  ruled as (select t.n, h || p as rule, v from tokens t join written on (t.host = h or ends_with(t.host, '.' || h)) and starts_with(t.path, p) qualify row_number() over (partition by t.n order by length(h) + length(p) desc, h desc, p desc) = 1)
select t.page_id, t.host, t.path, r.rule, coalesce(r.v, case when b.n is null then 'allow' else 'block' end) as verdict, array_to_string(b.x, ' ') as mined_rule, b.confidence
from tokens t left join ruled r on r.n = t.n left join best b on b.n = t.n
"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and one full of control strings, and read them back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(more)), dealt=True)


def _escaped(x: str) -> str:
    """SQL of the length of a string with every backslash doubled and one put into every control string."""
    inner = " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in [chat.ESCAPE, *chat.CONTROL_OPENINGS])
    return f"(length({x}) + {inner})"


_OP10_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, role = '{chat.ASSISTANT}' as reply, {len(chat.TURN_START) + len(chat.TEXT_START) + len(chat.TURN_END)} + {_escaped("role")} + {_escaped("text")} as chars,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as position
  from turns),
placed as (
  select *, sum(chars) over (partition by conv_id order by position) as upto, sum(chars) over (partition by conv_id) as whole,
    coalesce(max(case when reply then position end) over (partition by conv_id), 0) as last
  from sized)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by position)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (reply), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by position) filter (reply), '')) as loss_sha256,
  cast(coalesce(sum(upto) filter (reply), 0) + coalesce(sum(chars) filter (position > last), 0) as bigint) as formatted_chars,
  count(*) filter (reply) as n_examples
from placed group by conv_id
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the highest score for each benchmark item."""
    return ranked.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_OP11_SQL = f"""
with docs as (select row_number() over () as row, doc_id, {_TERMS} as t from documents where text is not null),
counted as (select row, doc_id, t, cast(len(t) as bigint) as n from docs where len(t) > 0),
held as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, n, unnest(t) as term from counted) q group by all),
wanted as (select distinct item_id, term from (select item_id, unnest({_TERMS}) as term from benchmark where text is not null) q),
sums as (select count(*) as docs, cast(sum(n) as bigint) as terms from counted),
weights as (select term, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from held cross join sums where term in (select term from wanted) group by term),
scores as (
  select item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) as bigint) as score
  from held join weights using (term) join wanted using (term) cross join sums group by item_id, row, doc_id),
ranks as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id nulls first) as integer) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranks where rank <= 10
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of documents, with each row's proof checked against tampered rows."""
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def _merkle_sql(fanout: int = merkle.FANOUT) -> str:
    """DuckDB SQL of the manifest: levels by recursion, proofs by joins with each level, folding by recursion over a leaf's proof."""
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256(concat({field('doc_id')}, {field('source')}, {field('lang')}, {field('n_chars')}, {field(text)}))"
    up = lambda name, by, key: f"""{name}_levels as (
  select {by}, 0 as lvl, idx, hash, n from {key}
  union all
  select {by}, lvl + 1, idx // {fanout}, sha256(string_agg(hash, '' order by idx)), any_value(n + {fanout - 1}) // {fanout} from {name}_levels where n > 1 group by {by}, lvl, idx // {fanout})"""  # noqa: E731
    runs = lambda name, by, base: f"""{name}_runs as (
  select {by}, lvl, idx,
    coalesce(string_agg(hash, '') over (w rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(hash, '') over (w rows between 1 following and unbounded following), '') as r
  from {name}_levels where n > 1 window w as (partition by {by}, lvl, idx // {fanout} order by idx)),
{name}_proofs as (
  select b.{base} as name, u.lvl, u.l, u.r from {base}s b join {name}_runs u on u.{by} = b.{by} and u.idx = b.idx // cast(pow({fanout}, u.lvl) as bigint))"""  # noqa: E731
    return f"""
with recursive t0 as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i)) as t),
ids as (select distinct doc_id from documents where doc_id is not null),
crcs as (select doc_id as crc_of, xor(list_reduce(list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda k: cast(ord(substr(cast(doc_id as varchar), k, 1)) as bigint)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) as crc from ids, t0),
hashed as (
  select d.doc_id, case when source is null then '0' else '1' || source end as grp, {leaf('text')} as hash,
    case when crc % 2 = 0 then {leaf("replace(text, chr(10), '')")} end as tampered
  from documents d left join crcs c on c.crc_of = d.doc_id),
leafs as materialized (
  select row_number() over () as leaf, *, row_number() over (partition by grp order by doc_id nulls first, hash) - 1 as idx, count(*) over (partition by grp) as n from hashed),
{up('tree', 'grp', 'leafs')},
tops as materialized (select grp as top, 0 as one, hash, row_number() over (order by encode(grp)) - 1 as idx, count(*) over () as n from tree_levels where n = 1),
{up('all', 'one', 'tops')},
{runs('tree', 'grp', 'leaf')},
{runs('all', 'one', 'top')},
proofs as (
  select name as leaf, lvl, l, r from tree_proofs
  union all
  select f.leaf, 1000 + a.lvl, a.l, a.r from leafs f join all_proofs a on a.name = f.grp),
steps as materialized (select leaf, row_number() over (partition by leaf order by lvl) as step, l, r from proofs),
folds as (
  select leaf, 0 as step, coalesce(tampered, hash) as value from leafs
  union all
  select f.leaf, f.step + 1, sha256(s.l || f.value || s.r) from folds f join steps s on s.leaf = f.leaf and s.step = f.step + 1),
proved as (select leaf, sha256(string_agg(l || r, '' order by step)) as proof_sha256, max(step) as steps from steps group by leaf),
root as (select hash as root from all_levels where n = 1)
select f.doc_id, f.hash as leaf, t.hash as subroot, root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, v.value as folded_root, v.value = root as verified
from leafs f join tops t on t.top = f.grp cross join root left join proved p on p.leaf = f.leaf join folds v on v.leaf = f.leaf and v.step = coalesce(p.steps, 0)
"""


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of documents in a sentencepiece model."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_language_id": op3_language_id,
    "op4_fertility_rules": op4_fertility_rules,
    "op5_token_files": op5_token_files,
    "op6_syncmer_fingerprints": op6_syncmer_fingerprints,
    "op7_source_mix": op7_source_mix,
    "op8_license_scan": op8_license_scan,
    "op9_url_rules": op9_url_rules,
    "op10_chat_format": op10_chat_format,
    "op11_ranked_search": op11_ranked_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_piece_round_trip": op13_piece_round_trip,
}
ORACLE_SQL: dict[str, str] = {"op1_minhash_dedup": _OP1_SQL, "op7_source_mix": mix_sql(), "op9_url_rules": _OP9_SQL, "op10_chat_format": _OP10_SQL, "op11_ranked_search": _OP11_SQL, "op12_merkle_manifest": _merkle_sql()}
