"""DuckDB counterparts of the registered queries."""

from __future__ import annotations

import fixtures as fx
from fixtures import duckdb_sql

GALLERY = duckdb_sql(fx.GALLERY)
GALLERY_LISTING = duckdb_sql(fx.GALLERY_LISTING)
GALLERY_REMOVED = duckdb_sql(fx.GALLERY_REMOVED)
FEED = duckdb_sql(fx.FEED)
LISTING = duckdb_sql(fx.LISTING)
USER_ROOTS = duckdb_sql(fx.USER_ROOTS)
REMOVED_ROOTS = duckdb_sql(fx.REMOVED_ROOTS)
CATALOG = f"""(
  select row_number() over (order by path) - 1 as slot, case when live then path end as path, size, live
  from {duckdb_sql(fx.OLD_STATE)} s
)"""

_COSINE = """1 - list_dot_product(cast(q.embedding as double[]), cast(g.embedding as double[]))
  / sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[])))
  / sqrt(list_dot_product(cast(g.embedding as double[]), cast(g.embedding as double[])))"""
_L2 = "power(list_distance(cast(q.embedding as double[]), cast(g.embedding as double[])), 2)"
# Distances are compared, and scores computed, on the grid that the search uses.
_REACH = """(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[]))
  + list_dot_product(cast(g.embedding as double[]), cast(g.embedding as double[])))"""
_GRID = f"power(2, ceil(log2({_REACH})) - 30)"
_SCORES = {
    "cosine": (f"round({_COSINE}, 10)", "cast(round(cast(100 * (1 - d) as decimal(20, 8)), 4) as double)"),
    "l2": (f"round({_L2} / {_GRID}) * {_GRID}", "cast(round(cast(100 * (1 - tanh(d / 3000)) as decimal(20, 14)), 6) as double)"),
}


def _hits(metric: str = "cosine", gallery: str = f"(select * from {GALLERY} x where live)") -> str:
    distance, score = _SCORES[metric]
    return f"""(
      select query_id, rank, slot, path, {score} as score, d from (
        select *, row_number() over (partition by query_id order by d, slot) as rank from (
          select q.vec_id as query_id, g.slot, g.path, {distance} as d
          from embeddings q, {gallery} g) pairs) ranked
      where rank <= 10)"""


def _knn(metric: str = "cosine", **gallery: str) -> str:
    return f"select query_id, rank, slot, path, score from {_hits(metric, **gallery)} h"


_LEFT_GALLERY = f"""(select * from {GALLERY} x where live and not exists (
  select 1 from {GALLERY_REMOVED} r where starts_with(x.path, r.root || '/')))"""

# Directories removed, and vectors turned round where their second component is high.
_LATER_GALLERY = f"""(select slot, path, case when embedding[2] > 0.1
    then list_transform(embedding, lambda x: -x) else embedding end as embedding from {_LEFT_GALLERY} l)"""

_SIZE_TEXT = """(((size * 100 // 1048576) + case
    when size * 100 % 1048576 > 524288 then 1
    when size * 100 % 1048576 = 524288 and (size * 100 // 1048576) % 2 = 1 then 1 else 0 end))"""


def _size_text() -> str:
    return (f"cast({_SIZE_TEXT} // 100 as varchar) || '.' || lpad(cast({_SIZE_TEXT} % 100 as varchar), 2, '0')"
            " || 'MB'")


_SHOWN = f"""(
  select h.*, l.size, l.modified, h.score as shown
  from {_hits()} h join {GALLERY_LISTING} l on h.path = l.path)"""


def _sorted(order: str) -> str:
    return f"""select query_id, row_number() over (partition by query_id order by {order}) as position, path
      from {_SHOWN} s"""


_SCALED = "list_transform(embedding, lambda x: case when x > 0.2 then 0.0 else cast(x as double) * 3.0 end)"


def _normalized(component: str) -> str:
    return f"""select vec_id, pos, round({component}, 6) as x from (
      select vec_id, unnest(v) as c, unnest(range(len(v))) as pos, sqrt(list_dot_product(v, v)) as norm
      from (select vec_id, cast({_SCALED} as double[]) as v from embeddings) s) c"""


_NEW = f"(select l.path, l.size from {LISTING} l where l.path not in (select path from {CATALOG} c where live))"
_MISSING = f"(select slot, path, size from {CATALOG} c where live and path not in (select path from {LISTING} l))"
_CHANGED = f"""(select c.slot, c.path, l.size from {CATALOG} c join {LISTING} l on c.path = l.path
  where c.live and c.size <> l.size)"""
_TOMBSTONED = f"""(select slot, case when keep then path end as path, size, keep as live from (
  select *, live and path in (select path from {LISTING} l) as keep from {CATALOG} c) k)"""


def _assigned(state: str) -> str:
    return f"""(
      with new as (select *, row_number() over (order by path desc) as turn,
                          row_number() over (order by path) - 1 as place from {_NEW} n),
           free as (select slot, row_number() over (order by slot) as turn from {state} s where not live)
      select coalesce(free.slot, (select max(slot) + 1 from {state} s) + new.place) as slot, new.path, new.size
      from new left join free on new.turn = free.turn)"""


_SYNCED = f"""(
  select c.slot, c.path, coalesce(l.size, c.size) as size from {_TOMBSTONED} c
  left join {LISTING} l on c.path = l.path where c.live
  union all select * from {_assigned(_TOMBSTONED)} a)"""

_HOSTS = duckdb_sql(fx.HOST_ROOTS)
_ASKED = duckdb_sql(fx.PAGE_ROOTS)
_REGISTER = f"""
with old as (select root from {_HOSTS} h),
asked as (select root, ordinal from {_ASKED} p),
firsts as (select root, min(ordinal) as first from asked group by root),
known as (select root, cast(-1 as bigint) as since from old union all select root, first from firsts),
covered as (select f.root, min(k.since) as since from firsts f
  join known k on starts_with(f.root, k.root || '/') group by f.root),
judged as (select a.root, a.ordinal, f.first, c.since, a.root in (select root from old) as is_old
  from asked a join firsts f on a.root = f.root left join covered c on a.root = c.root)
select root, ordinal, case
  when is_old then 'duplicate'
  when ordinal > first and not coalesce(since < first, false) then 'duplicate'
  when since < ordinal then 'covered' else 'added' end as status
from judged"""

_LIVE = f"(select * from {GALLERY} x where live)"


def _enough(asked: str) -> str:
    """Queries per label, their exact hits, and that a search finds enough of them."""
    return f"""select label, count(*) as queries, cast(count(*) * least(10, (select count(*) from {_LIVE} l)) as bigint) as hits,
      true as enough from {asked} a group by label"""


# Cells around the labels' mean vectors; a vector belongs to the nearest one, a query probes the nearest ones.
_PROBED = f"""
with means as (
  select label, list(x order by i) as center from (
    select label, i, avg(cast(x as double)) as x from (
      select label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings) c group by label, i) m
  group by label),
units as (
  select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u
  from (select vec_id, cast(embedding as double[]) as v from embeddings) e),
cells as (
  select vec_id, label, row_number() over (partition by vec_id order by list_distance(u, center), label) as place
  from units, means),
exact as (select query_id, slot from {_hits()} h),
probed as (
  select query_id, slot, n from (
    select q.query_id, g.slot, n, row_number() over (partition by q.query_id, n order by q.d, g.slot) as rank
    from (select q.vec_id as query_id, g.slot, {_SCORES["cosine"][0]} as d from embeddings q, {_LIVE} g) q
    join (select slot from {_LIVE} l) g on g.slot = q.slot
    join cells c on c.vec_id = g.slot and c.place = 1
    join cells a on a.vec_id = q.query_id and a.label = c.label
    join (select unnest([1, 4, 10]) as n) p on a.place <= n) r
  where rank <= 10)"""

_SPACED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[\t\n\r\p{Zs}]', ' ', 'g'),
  '[\x00\x{FFFD}\p{Cc}\p{Cf}]', '', 'g'),
  '([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])', ' \1 ', 'g'),
  '^\s+|\s+$', '', 'g')"""
_WORDS = rf"""list_filter(regexp_split_to_array(
  regexp_replace(strip_accents(lower({_SPACED})), '([!-/:-@\[-`{{-~\p{{P}}])', ' \1 ', 'g'),
  '[\s\x{{2028}}\x{{2029}}]+'), lambda x: x <> '')"""


# What joined tokens are cleaned of, in this order.
_CLEAN_UP = (
    (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"),
    (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"),
)


def _cleaned(text: str) -> str:
    for found, written in _CLEAN_UP:
        quoted_found, quoted_written = (s.replace("'", "''") for s in (found, written))
        text = f"replace({text}, '{quoted_found}', '{quoted_written}')"
    return text


_VOCABULARY = f"""(
  with words as (select distinct unnest({_WORDS}) as token from benchmark),
  chars as (select distinct unnest(string_split(token, '')) as token from words),
  tokens as (select token from words union select token from chars where token <> ''
             union select '##' || token from chars where token <> '')
  select token, 3 + row_number() over (order by token) as id from tokens
  union all select * from (values ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)) s(token, id))"""

# Greedy longest match of each distinct word, one piece per step.
_PIECES = f"""
with recursive vocab as materialized (select * from {_VOCABULARY} v),
doc_words as materialized (
  select doc_id, unnest(words) as word, unnest(range(len(words))) as pos
  from (select doc_id, {_WORDS} as words from documents) d),
steps(word, done, ids, failed) as (
  select distinct word, 0, cast([] as bigint[]), length(word) > 200 from doc_words
  union all
  select s.word, coalesce(b.stop, s.done), case when b.id is null then s.ids else list_append(s.ids, b.id) end,
         b.id is null
  from (select * from steps where done < length(word) and not failed) s
  left join lateral (
    select arg_max(v.id, e.stop) as id, max(e.stop) as stop
    from (select unnest(range(s.done + 1, length(s.word) + 1)) as stop) e
    join vocab v on v.token = case when s.done > 0 then '##' else '' end || substr(s.word, s.done + 1, e.stop - s.done)
  ) b on true),
split as (
  select word, case when failed then [cast(1 as bigint)] else ids end as ids from steps
  where failed or done = length(word)),
pieces as (
  select d.doc_id, coalesce(flatten(list(s.ids order by d.pos) filter (s.word is not null)), []) as ids
  from (select doc_id from documents) d0 join doc_words d on d0.doc_id = d.doc_id join split s on d.word = s.word
  group by d.doc_id)
"""
_DOC_PIECES = f"""{_PIECES}, doc_pieces as (
  select doc_id, coalesce(p.ids, cast([] as bigint[])) as ids from documents left join pieces p using (doc_id))
"""

_SPLIT = r"regexp_split_to_array(trim(text), '[\s|,]')"


def _rewritten(lead: str) -> str:
    return f"""select query_id, case when len(w) > 1
        then '一张照片同时包含了' || array_to_string({lead}, '、') || '和' || w[-1] else t end as prompt
      from (select query_id, trim(text) as t, {_SPLIT} as w from {duckdb_sql(fx.KEYWORDS)} k) s"""


# Documents, and the queries' prompts under negative numbers.
_TEXTS = f"""(select doc_id, text from documents union all
  select -1 - query_id, prompt from ({_rewritten("w[:-2]")}) r where prompt <> '')"""
# The signs of each token id, out of a hash of id and place; products are taken modulo 2^64.
_HASHED = "cast((cast({x} as uhugeint) * {factor}) % 18446744073709551616 as ubigint)"
_MIXED = _HASHED.format(x="xor(x, x >> 30)", factor=0xBF58476D1CE4E5B9)
_MIXED = _MIXED, _HASHED.format(x="xor(y, y >> 27)", factor=0x94D049BB133111EB)
_TEXT_SEARCH = f"""{_DOC_PIECES.replace("from documents", f"from {_TEXTS} t")},
long as (
  select doc_id, pos // 50 as part, id
  from (select doc_id, unnest(ids) as id, unnest(range(len(ids))) as pos from doc_pieces) a),
frames as (
  select distinct doc_id, part from long union select doc_id, 0 from doc_pieces),
counted as (
  select doc_id, part, id, count(*) as n from (
    select * from long union all select doc_id, part, unnest([2, 3]) from frames) a where id <> 0 group by all),
signs as (
  select id, j, case when xor(z, z >> 31) & 1 = 1 then 1 else -1 end as s from (
    select id, j, {_MIXED[1]} as z from (
      select id, j, {_MIXED[0]} as y from (
        select id, j, cast(id * 64 + j as ubigint) as x from (select distinct id from counted), (select unnest(range(64)) as j)) a) b) c),
sums as (select doc_id, part, j, cast(sum(n * s) as double) as v from counted join signs using (id) group by doc_id, part, j),
raw as (select doc_id, part, list(v order by j) as v from sums group by doc_id, part),
vectors as (
  select doc_id, list_transform(v, lambda x: cast(x / sqrt(list_dot_product(v, v)) as float)) as embedding
  from raw where list_dot_product(v, v) > 0),
pairs as (
  select -1 - q.doc_id as query_id, g.doc_id as slot, min({_SCORES["cosine"][0]}) as d
  from vectors q, vectors g where q.doc_id < 0 and g.doc_id >= 0 group by all),
ranked as (select *, row_number() over (partition by query_id order by d, slot) as rank from pairs)
select query_id, rank, slot, '/doc/' || slot as path, {_SCORES["cosine"][1]} as score from ranked where rank <= 10"""

_LINES = duckdb_sql(fx.LOG_LINES)
_DAY = "try_cast(regexp_extract(line, '^\\d{4}-\\d{2}-\\d{2}') as date)"

_PIXELS = "list_transform(embedding, lambda x: cast(floor(abs(cast(x as double)) * 100000) as bigint) % 256)"
_BLEND = "(p[4 * i + 3 - c] * p[4 * i + 4] + 128)"
# float32 arithmetic, as in the model input.
_MODELS = ("[0.48145466, 0.4578275, 0.40821073]", "[0.26862954, 0.26130258, 0.27577711]"), ("[0.485, 0.456, 0.406]", "[0.229, 0.224, 0.225]")
_TENSOR, _OTHER_TENSOR = (f"""(
  select vec_id, c * 16 + i as pos,
    cast((cast((({_BLEND} >> 8) + {_BLEND}) >> 8 as float) / cast(255 as float)
      - cast({mean}[c + 1] as float))
      / cast({std}[c + 1] as float) as double) as x
  from (select vec_id, cast({_PIXELS} as bigint[]) as p from embeddings where embedding[4] >= -0.15) e,
       (select unnest(range(3)) as c) planes, (select unnest(range(16)) as i) pixels)""" for mean, std in _MODELS)

_CUBIC = """case when abs(d) < 1 then (1.5 * abs(d) - 2.5) * d * d + 1
    when abs(d) < 2 then ((-0.5 * abs(d) + 2.5) * abs(d) - 4) * abs(d) + 2 else 0 end"""


def _resized(size: int, target: int) -> str:
    """The pictures at another size: bicubic weights as whole numbers, first along the lines, then along the columns."""
    scale, wide = size / target, max(size / target, 1.0)
    step = f"least(greatest((sum(w * v) + {1 << 21}) >> 22, 0), 255)"
    return f"""
      with parts as (
        select o, i, {_CUBIC} as k from (
          select o, i, (i - (o + 0.5) * {scale} + 0.5) / {wide} as d,
            greatest(trunc((o + 0.5) * {scale} - 2 * {wide} + 0.5), 0) as low,
            least(trunc((o + 0.5) * {scale} + 2 * {wide} + 0.5), {size}) as high
          from (select unnest(range({target})) as o) os, (select unnest(range({size})) as i) inputs) p
        where i >= low and i < high),
      weights as (select o, i, cast(floor(k / sum(k) over (partition by o) * {1 << 22} + 0.5) as bigint) as w from parts),
      pixels as (
        select vec_id, c, i // {size} as y, i % {size} as x, (({_BLEND} >> 8) + {_BLEND}) >> 8 as v
        from (select vec_id, cast({_PIXELS} as bigint[]) as p from embeddings where embedding[4] >= -0.15) e,
             (select unnest(range(3)) as c) planes, (select unnest(range({size * size})) as i) places),
      wider as (select vec_id, c, y, o as x, cast({step} as bigint) as v from pixels join weights on x = i group by vec_id, c, y, o),
      higher as (select vec_id, c, o as y, x, cast({step} as bigint) as v from wider join weights on y = i group by vec_id, c, o, x)
      select vec_id, c * {target * target} + y * {target} + x as pos, round(cast((cast(v as float) / cast(255 as float)
        - cast([0.48145466, 0.4578275, 0.40821073][c + 1] as float))
        / cast([0.26862954, 0.26130258, 0.27577711][c + 1] as float) as double), 4) as x from higher"""


ORACLES = {
    "knn_cosine_topk": _knn(),
    "knn_l2_topk": _knn("l2"),
    "knn_single_query": f"""
      with mean as (select list(x order by i) as embedding from (
        select i, avg(cast(x as double)) as x from (
          select unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings) c group by i) m)
      select slot, round(100 * (1 - d), 4) as score from (
        select g.slot, {_COSINE} as d from mean q, (select * from {GALLERY} x where live) g) s
      order by round(d, 10), slot limit 10""",
    "knn_cell_join_cosine": _knn(),
    "knn_cell_join_l2": _knn("l2"),
    "knn_ivf_full_probe": _knn(),
    "knn_ivf_recall": f"""{_PROBED}
      select n as nprobe, round(count(p.slot) / count(*), 6) as recall
      from (select *, unnest([1, 4, 10]) as n from exact) e left join probed p using (query_id, slot, n) group by n""",
    "knn_pq_rerank": _knn(),
    "knn_pq_recall": _enough("embeddings"),
    "knn_graph_self": _enough(f"(select label from embeddings where vec_id in (select slot from {_LIVE} l))"),
    "knn_after_directory_removal": _knn(gallery=_LEFT_GALLERY),
    "knn_existing_only": f"""select query_id, rank, slot, path, score from {_hits()} h
      where path in (select path from {GALLERY_LISTING} l)""",
    "search_result_columns": f"""select query_id, rank, path, substr(md5(path), 1, 16) as row_id,
      {_size_text()} as size_text, strftime(modified, '%Y-%m-%d %H:%M:%S') as modified_text, shown as score
      from {_SHOWN} s""",
    "search_score_text": f"select query_id, path, printf('%.2f%%', 100 * (1 - d)) as score_text from {_SHOWN} s",
    "search_repeated_paths": f"""select query_id, rank, substr(md5(dir), 1, 16)
        || repeat('#', cast(row_number() over (partition by query_id, dir order by rank) - 1 as int)) as row_id
      from (select query_id, rank, regexp_replace(path, '/[^/]*$', '') as dir from {_hits()} h) s""",
    "search_after_sync": _knn(gallery=_LATER_GALLERY),
    "knn_cells_after_upserts": _knn(gallery=_LATER_GALLERY),
    "search_kept_index": _knn(gallery=_LATER_GALLERY),
    "standing_topk_after_commits": _knn(gallery=_LATER_GALLERY),
    "search_sorted_by_size": _sorted("size, rank"),
    "search_sorted_by_score": _sorted("d, rank"),
    "search_sorted_by_modified": _sorted("modified, substr(md5(path), 1, 16)"),
    "search_resized": _knn(),
    "normalize_vectors": _normalized("c / norm"),
    "normalize_vectors_legacy": _normalized("case when c = 0 then 1.0 else c end / norm"),
    "catalog_live_count": f"select count(*) as live_count from {CATALOG} c where live",
    "result_count_k": f"select least(100, count(*)) as result_count from {CATALOG} c where live",
    "catalog_changed": f"select * from {_CHANGED} c",
    "catalog_new": f"select * from {_NEW} n",
    "catalog_missing": f"select * from {_MISSING} m",
    "catalog_diff": f"""select slot, path, size, 'missing' as status from {_MISSING} m
      union all select slot, path, size, 'changed' from {_CHANGED} c
      union all select -1, path, size, 'new' from {_NEW} n""",
    "catalog_diff_by_digest": f"""select slot, path, size, 'missing' as status from {_MISSING} m
      union all select slot, path, size, 'changed' from {_CHANGED} c
      union all select -1, path, size, 'new' from {_NEW} n""",
    # Users' directories lie side by side below /lib, so an unchanged one is outermost unless all of /lib is.
    "catalog_unchanged_trees": f"""
      with old as (select regexp_replace(path, '/[^/]*$', '') as dir, list((path, size) order by path) as files
          from {CATALOG} c where live group by 1),
      now as (select path, size, cast(regexp_extract(path, '^/lib/u([0-9]+)/', 1) as bigint) % 2 = 0 as even from {LISTING} l),
      mixed as (select path, size from now where not even union all
        select path, size from {CATALOG} c where live and cast(regexp_extract(path, '^/lib/u([0-9]+)/', 1) as bigint) % 2 = 0),
      new as (select regexp_replace(path, '/[^/]*$', '') as dir, list((path, size) order by path) as files from mixed group by 1)
      select old.dir from old join new on old.dir = new.dir and old.files = new.files""",
    "catalog_worklist": f"select * from {_CHANGED} c union all select * from {_assigned(CATALOG)} a",
    "catalog_existing": f"""select slot, path, size, live from {CATALOG} c
      where live and path in (select path from {LISTING} l)""",
    "catalog_tombstoned": f"select * from {_TOMBSTONED} t",
    "catalog_assign_slots": f"select slot, path from {_assigned(_TOMBSTONED)} a",
    "catalog_densify": f"""select slot, path, case when live then size else 0 end as size, live from {CATALOG} c
      where slot <= (select max(slot) from {CATALOG} m where live)""",
    "catalog_after_sync": f"select * from {_SYNCED} s",
    "catalog_after_compaction": f"select * from {_SYNCED} s",
    "catalog_rebuilt": f"select row_number() over (order by path) - 1 as slot, path, size from {LISTING} l",
    "catalog_unregistered": f"""select path, size from {LISTING} l
      where not exists (select 1 from {REMOVED_ROOTS} r where starts_with(l.path, r.root || '/'))""",
    "catalog_json_array": f"select * from {CATALOG} c",
    "catalog_json_lines": f"select * from {CATALOG} c",
    "catalog_remove_directories": f"""select slot, path, size from {CATALOG} c
      where live and exists (select 1 from {REMOVED_ROOTS} r where starts_with(c.path, r.root || '/'))""",
    "roots_register": _REGISTER,
    "roots_unregister": f"select root from {USER_ROOTS} u where root not in (select root from {REMOVED_ROOTS} r)",
    "tokens_basic": f"select doc_id, array_to_string({_WORDS}, ' ') as tokens from documents",
    "tokens_wordpiece_ids": f"{_DOC_PIECES} select doc_id, array_to_string(ids, ' ') as ids from doc_pieces",
    "tokens_wordpiece_by_join": f"{_DOC_PIECES} select doc_id, array_to_string(ids, ' ') as ids from doc_pieces",
    "model_input_rows": f"""{_DOC_PIECES} select doc_id, array_to_string(
        list_resize(list_concat([2], ids[1:50], [3]), 52, 0), ' ') as input_ids from doc_pieces""",
    "tokens_from_ids": f"""{_DOC_PIECES}, long as (
        select doc_id, unnest(ids) as id, unnest(range(len(ids))) as pos from doc_pieces),
      named as (select doc_id, string_agg(token, ' ' order by pos) as tokens from long join vocab using (id)
        group by doc_id)
      select doc_id, coalesce(tokens, '') as tokens from documents left join named using (doc_id)""",
    "tokens_to_string": f"""select doc_id,
      {_cleaned(f"trim(replace(array_to_string({_WORDS}, ' '), ' ##', ''))")} as text from documents""",
    "vocab_load": r"""select token, max(id) as id from (
      select trim(value, e' \t\n\r') as token, row_number() over (order by value) - 1 as id from (
        select unnest(regexp_split_to_array(text, '[ \n]+')) as value from conversations) w) v group by token""",
    "vocab_size": f"select count(distinct token) as vocab_size from {_VOCABULARY} v",
    "query_rewrite": _rewritten("w[:-2]"),
    "query_rewrite_legacy": _rewritten("w[:-3]"),
    "text_search_hashed": _TEXT_SEARCH,
    "log_retention": f"""select event_id, line from {_LINES} l
      where date_diff('day', {_DAY}, date '2024-01-31') < 7""",
    "log_retention_legacy": f"select event_id, line from {_LINES} l where {_DAY} < date '2024-02-07'",
    "log_parsed": f"""select cast({_DAY} as varchar) as day, substr(line, 28) as message, count(*) as lines
      from {_LINES} l where {_DAY} is not null group by all""",
    "export_names": f"""select src_path, case when n = 1 then source || '.txt'
        else source || ' (' || n || ').txt' end as target_name
      from (select *, regexp_extract(src_path, '([^/]+)\\.txt$', 1) as source,
        row_number() over (partition by regexp_extract(src_path, '([^/]+)$') order by ordinal) as n
        from {duckdb_sql(fx.EXPORTED)} e) s""",
    "export_names_beside_taken": f"""select src_path, case when n = 1 then source || '.txt'
        else source || ' (' || n || ').txt' end as target_name
      from (select src_path, source, row_number() over (partition by source order by ordinal)
          + case when source || '.txt' in (select name from {duckdb_sql(fx.EXPORT_TAKEN)} t) then 1 else 0 end as n
        from (select *, regexp_extract(src_path, '([^/]+)\\.txt$', 1) as source from {duckdb_sql(fx.EXPORTED)} e) s) r""",
    "export_copies": """select src_path, case when n = 1 then stem || '.txt' else stem || ' (' || n || ').txt' end as target_name,
      doc_id % 10 <> 0 as ok, case when doc_id % 10 <> 0 then strlen(text) else 0 end as bytes
      from (select *, doc_id || '/' || stem || '.txt' as src_path, row_number() over (partition by stem order by doc_id) as n
        from (select *, cast(doc_id % 50 as varchar) as stem from documents) d) s""",
    "listing_from_inventory": f"""select path, size, strftime(modified, '%Y-%m-%d %H:%M:%S') as modified from (
        select *, row_number() over (partition by path order by modified desc) as n from {duckdb_sql(fx.INVENTORY)} i
        where regexp_matches(lower(path), '[^/]\\.(png|jpg|jpeg|tiff|bmp|gif|webp)$')
          and exists (select 1 from {duckdb_sql(fx.INVENTORY_ROOTS)} r where starts_with(i.path, r.root || '/'))) v
      where n = 1 and size is not null""",
    "listing_of_written_files": """select source || '/' || lang || '/' || doc_id || '.png' as path, strlen(text) as size
      from documents""",
    "listing_accepted": f"""select * from {duckdb_sql(fx.MIXED_FILES)} m
      where regexp_matches(lower(path), '[^/]\\.(png|jpg|jpeg|tiff|bmp|gif|webp)$')""",
    "size_display": f"""select path, {_size_text()} as size_text, substr(md5(path), 1, 16) as row_id
      from {LISTING} l""",
    "ingest_latest_state": f"select path, size from {LISTING} l",
    "ingest_out_of_order": f"select path, size from {LISTING} l",
    "ingest_with_failures": f"select path, size, cast(cast(size as float) as double) as first from {LISTING} l",
    "query_stream_topk": _knn(),
    "image_size_report": """select '/gallery/' || vec_id || '.png' as origin,
      case when embedding[4] >= -0.15 then 4 else 0 end as width,
      case when embedding[4] >= -0.15 then 4 else 0 end as height,
      case when embedding[4] >= -0.15 then '' else 'image could not be decoded' end as error from embeddings""",
    "image_tensor": f"select vec_id, pos, round(x, 4) as x from {_TENSOR} t",
    "image_tensor_resized": _resized(4, 8),
    "image_tensor_shrunk": _resized(4, 3),
    "image_embedding_second_model": f"""
      with planes as (select vec_id, pos // 16 as c, avg(x) as mean, stddev_pop(x) as deviation
        from {_OTHER_TENSOR} t group by all)
      select vec_id, c as pos, round(mean, 3) as x from planes union all select vec_id, 3 + c, round(deviation, 3) from planes""",
    "image_embedding": f"""
      with planes as (select vec_id, pos // 16 as c, avg(x) as mean, stddev_pop(x) as deviation
        from {_TENSOR} t group by all),
      parts as (select vec_id, c as pos, mean as v from planes union all select vec_id, 3 + c, deviation from planes)
      select vec_id, pos, round(v / sqrt(sum(v * v) over (partition by vec_id)), 3) as x from parts""",
}
