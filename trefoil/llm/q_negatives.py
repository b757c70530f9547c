"""Registered query of the hard-negative mining."""

from pyspark.sql import functions as F

from .common import table
from .negatives import hard_negatives
from .registry import query

NEGATIVES_SQL = """with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as x, row_number() over () as r
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
),
a as (select * from v where vec_id % 100 = 0),
s as (
  select a.r, a.vec_id as anchor_id, v.vec_id, v.r as other, a.label = v.label as same, cast(list_dot_product(a.x, v.x) as bigint) as score
  from a join v on a.r <> v.r and len(a.x) = len(v.x)
),
p as (
  select * from (select *, row_number() over (partition by r order by score desc, vec_id, other) as place from s where same) where place <= 5
),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.r, p.place order by s.score desc, s.vec_id, s.other) as rank
  from p join s on s.r = p.r and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)
