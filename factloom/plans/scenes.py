"""Orders as scenes: their lines are objects with boxes, their brands' groups categories; what may be changed and claimed."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import candidates as cd
from ..operators import transitions as tr
from ..sources.tables import dealt, in_place, materialize, spread_by
from .registry import query

SCENES_SQL = """with lines as (select l_orderkey as scene, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_shipdate) as n, l_partkey as p, l_suppkey as s, l_quantity::double as x, l_discount::double as y, l_tax::double as z from lineitem),
objects as (select scene, 'o' || n as object_id, 'kind_' || p % 9 as category, n, p, s, x / 8 as x_low, x / 8 + 1 as x_high, y * 20 as y_low, y * 20 + 1 as y_high, z * 20 as z_low, z * 20 + 1 as z_high from lines),
counts as (select scene, category, count(*) as n from objects group by all), relations as (select scene, object_id as subject_id, ['left', 'behind', 'above', 'beside'][1 + s % 4] as word, 'o' || (n + 1) as object_id from objects where p % 3 = 0),
one as (select o.* from objects o join counts c using (scene, category) where c.n = 1),
added as (select scene, 'ADD_AND_RECOUNT' as family, null as target, category, null as new_category, null as anchor, null as pre_predicate, null as post_predicate, 'COUNT' as source_group from counts),
removed as (select scene, 'REMOVE_AND_RECOUNT', object_id, category, null, null, null, null, 'OBJECT' from one),
replaced as (select o.scene, f.f, o.object_id, o.category, c.category, null, null, null, 'COUNT_AND_OBJECT' from one o join counts c on o.scene = c.scene and o.category <> c.category, (values ('REPLACE_AND_RECOUNT'), ('REPLACEMENT_IDENTITY')) f(f)),
stated as (select r.scene, r.subject_id as a, r.object_id as b, case word when 'left' then 'LEFT_OF' when 'behind' then 'BEHIND' else 'ABOVE' end as p, 0 as source from relations r join one s on r.scene = s.scene and r.subject_id = s.object_id join one o on r.scene = o.scene and r.object_id = o.object_id where word <> 'beside'),
boxes as (select a.scene, a.object_id as a, b.object_id as b, case when a.x_high + 0.02 < b.x_low then 'LEFT_OF' when b.x_high + 0.02 < a.x_low then 'RIGHT_OF' when b.y_high + 0.02 < a.y_low then 'FRONT_OF' when a.y_high + 0.02 < b.y_low then 'BEHIND' when b.z_high + 0.02 < a.z_low then 'ABOVE' when a.z_high + 0.02 < b.z_low then 'BELOW' end as p, 1 as source
  from one a join one b on a.scene = b.scene and a.object_id < b.object_id),
found as (select scene, a, b, p, min(source) as source from (select * from stated union all select * from boxes) where p is not null group by all),
related as (select found.scene, f.f, found.a, o.category, null, found.b, found.p, case found.p when 'LEFT_OF' then 'RIGHT_OF' when 'RIGHT_OF' then 'LEFT_OF' when 'FRONT_OF' then 'BEHIND' when 'BEHIND' then 'FRONT_OF' when 'ABOVE' then 'BELOW' else 'ABOVE' end, case source when 0 then 'STATED' else 'BOXES' end
  from found join one o on found.scene = o.scene and found.a = o.object_id, (values ('MOVE_TO_OPPOSITE_SIDE'), ('SWAP_POSITIONS')) f(f)),
candidates as (select * from added union all select * from removed union all select * from replaced union all select * from related)
"""


def _scenes(t):
    """objects, counts and stated relations of all orders. Lines are dealt by scene once; what is made of them stays there."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = t("lineitem").select(F.col("l_orderkey").alias("scene"), F.row_number().over(order).alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), *[F.col(c).cast("double").alias(a) for a, c in (("x", "l_quantity"), ("y", "l_discount"), ("z", "l_tax"))])
    lines = dealt(lines, "scene", "scenes")
    low = {"x": F.col("x") / 8, "y": F.col("y") * 20, "z": F.col("z") * 20}
    rows = lines.select("scene", "n", "p", "s", F.concat(F.lit("o"), "n").alias("object_id"), F.concat(F.lit("kind_"), (F.col("p") % 9).cast("string")).alias("category"), *[c for a, v in low.items() for c in (v.alias(f"{a}_low"), (v + 1).alias(f"{a}_high"))])
    objects = rows.drop("n", "p", "s")
    word = F.get(F.array(*map(F.lit, ("left", "behind", "above", "beside"))), (F.col("s") % 4).cast("int"))
    relations = rows.where("p % 3 = 0").select("scene", F.col("object_id").alias("subject_id"), word.alias("word"), F.concat(F.lit("o"), (F.col("n") + 1).cast("string")).alias("object_id"))
    return objects, objects.groupBy("scene", "category").agg(F.count("*").alias("n")), relations


def _candidates(objects, counts, relations):
    return cd.with_ids(cd.count_candidates(counts, objects).unionByName(cd.relation_candidates(objects, relations, counts)))


def _claims(objects, counts, relations):
    """Numbers of claims. Changes of counts and of relations have other families, so each are carried out on their own: fewer joins lie in one task. Relations
    are written, since their candidates are also facts that each lookup of the checker reads."""
    out, moves = [], dealt(cd.relation_candidates(objects, relations, counts), "scene", "moves")
    for some in (cd.count_candidates(counts, objects), moves):
        found = cd.with_ids(some)
        # without scene beside state, so that the candidates' union stays dealt by state
        claims = cd.claimed(tr.checked(found.drop("scene"), cd.pre_facts(counts, objects, found), "*"), "source_group")
        out.append(claims.groupBy("family", "source_group", "code", "changed_slot").agg(F.count("*").alias("n")))
    return out[0].unionByName(out[1])


@query(SCENES_SQL + "select * from candidates")
@spread_by("lineitem")
def scene_candidates(t):
    """What may be changed in each scene: additions, removals, replacements, moves and swaps."""
    found = _candidates(*_scenes(t))
    rows = found.select(F.col("scene").cast("bigint").alias("scene"), "family", "target", "category", "new_category", "anchor", "pre_predicate", "post_predicate", "source_group")
    with in_place(found.sparkSession):
        return materialize(rows, "candidates")


@query(SCENES_SQL + """select family, source_group, null::varchar as code, case when family in ('MOVE_TO_OPPOSITE_SIDE', 'SWAP_POSITIONS') then 'predicate' else 'value' end as changed_slot, count(*) as n from candidates group by all""")
@spread_by("lineitem")
def scene_claims(t):
    """Candidates carried out by the checker, and a pair of claims of each that its facts decide: all of them, by the SQL."""
    with in_place(t("lineitem").sparkSession):
        return materialize(_claims(*_scenes(t)), "claims")
