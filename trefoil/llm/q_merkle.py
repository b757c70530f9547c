"""Registered query of the Merkle manifest."""

from pyspark.sql import functions as F

from .common import table
from .merkle import manifest, proof_text
from .registry import query

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf(text="text"):
    part = "coalesce(strlen(cast({0} as varchar)) || ':' || {0}, '-')"
    return "sha256(" + " || ".join(part.format(c) for c in [*FIELDS[:-1], text]) + ")"


# Bit by bit: a byte is taken in (at least 0), then eight shifts (-1) follow.
_CRC = """xor(4294967295, list_reduce(flatten([[4294967295], flatten([[ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::varchar, '')])]),
  lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"""


def _levels(name, start):
    """All nodes of the trees of groups ``g``, level by level, 16 to a run."""
    return f"""{name}(lvl, g, idx, h) as ({start}
  union all select lvl + 1, g, idx // 16, sha256(string_agg(h, '' order by idx))
  from (select *, count(*) over (partition by g) as c from {name}) where c > 1 group by lvl, g, idx // 16)"""


def _beside(name, nodes, tree):
    """The digests beside the way of each node, level by level."""
    return f"""{name} as (select d.r, u.lvl, coalesce(string_agg(h, '' order by u.idx) filter (u.idx < d.idx // (16 ** u.lvl)::bigint), '') as b,
    coalesce(string_agg(h, '' order by u.idx) filter (u.idx > d.idx // (16 ** u.lvl)::bigint), '') as a
  from {nodes} d join {tree} u on u.g is not distinct from d.g and u.idx // 16 = d.idx // (16 ** (u.lvl + 1))::bigint
  where u.lvl < (select max(t.lvl) from {tree} t where t.g is not distinct from d.g) group by 1, 2)"""


MERKLE_SQL = f"""with recursive leaves as (
  select doc_id, source as g, {_leaf()} as leaf,
    case when {_CRC} % 5 = 0 then {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as changed from documents
), low as (select *, row_number() over (order by g nulls first, doc_id nulls first, leaf) as r,
    row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx from leaves
), {_levels("up", "select 0, g, idx, leaf from low")},
subs as (select g as source, h as subroot, row_number() over (order by g nulls first) as r, row_number() over (order by g nulls first) - 1 as idx, 0 as g
  from (select g, h, row_number() over (partition by g order by lvl desc) as k from up) where k = 1
), {_levels("top", "select 0, g, idx, subroot from subs")},
{_beside("low_way", "low", "up")}, {_beside("top_way", "subs", "top")},
joined as (select low.*, subroot, subs.r as s, (select h from top order by lvl desc limit 1) as root
  from low join subs on subs.source is not distinct from low.g),
way as (select r, lvl, b, a from low_way union all
  select joined.r, 1000 + lvl, b, a from joined join top_way on top_way.r = s),
ways as (select r, list({{'b': b, 'a': a}} order by lvl) as way, string_agg(b || a, '' order by lvl) as beside from way group by 1),
folded as (select joined.*, coalesce(beside, '') as beside,
  list_reduce(list_concat([{{'b': coalesce(changed, leaf), 'a': ''}}], coalesce(way, [])), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b as folded_root
  from joined left join ways using (r))
select doc_id, leaf, subroot, root, sha256(beside) as proof_sha256, folded_root, folded_root = root as verified from folded"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents").select(*FIELDS)
    # Every fifth row, by the checksum of its id, is held with its capitals lost.
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = manifest(docs, FIELDS, "source", "doc_id", tampered, {"text": F.translate("text", UPPER, LOWER)})
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")
