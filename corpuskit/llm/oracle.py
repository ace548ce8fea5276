"""SQL for those training-data queries that SQL can express.

The others are tested against brute force, round trips or held-out accuracy in tests/llm.
"""

_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\x{{3000}}\x{{00a0}}]+|[\s\x{{3000}}\x{{00a0}}]+$', '', 'g')), '')"

ORACLE: dict[str, str] = {
    "p1_found": "with recursive e as (select distinct comparisonId as c, unnest(list_filter(['g' || " + _KEY.format('"group"') + ", 'p' || " + _KEY.format("postId") + ", 'f' || " + _KEY.format("family")
    + "], lambda x: x is not null)) as k from comparisons where comparisonId is not null), r(c, d) as (select distinct comparisonId, comparisonId from comparisons where comparisonId is not null union select r.c, b.c from r join e a on a.c = r.d join e b on b.k = a.k), s as (select distinct comparisonId, case when "
    + _KEY.format("split") + " in ('train', 'training', 'trn') then 'train' when " + _KEY.format("split") + " in ('validation', 'valid', 'validate', 'val', 'dev', 'development') then 'validation' when " + _KEY.format("split")
    + " in ('test', 'tests', 'testing', 'tst') then 'test' end as s from comparisons) select r.c as comparisonId from r join s on s.comparisonId = r.d group by r.c having count(distinct s.s) > 1",
    "p5_agreement": "with a as (select comparisonId, dimension, " + _KEY.format("annotatorId") + " as who, " + _KEY.format("choice") + " as c, row_number() over (partition by comparisonId, dimension, " + _KEY.format("annotatorId")
    + " order by coalesce(revision, 0) desc, savedAt desc nulls last, case " + _KEY.format("choice") + " when 'left' then 1 when 'right' then 2 when 'tie' then 3 when 'both_bad' then 4 else 0 end desc) as rn from preferences where comparisonId is not null and dimension is not null), "
    "h as (select comparisonId, dimension, c from a where rn = 1 and who is not null and c in ('left', 'right', 'tie', 'both_bad')), "
    "i as (select comparisonId, dimension, c, count(*) as k, sum(count(*)) over (partition by comparisonId, dimension) as n from h group by 1, 2, 3), "
    "s as (select dimension, c, sum(k) as k, sum(k * (k - 1)::double / (n - 1)) as same from i where n > 1 group by 1, 2), "
    "z as (select dimension, sum(k) as m, sum(same) / sum(k) as observed, sum(k::double * (k - 1)) / (sum(k)::double * (sum(k) - 1)) as chance from s group by 1) "
    "select z.dimension, (select count(distinct comparisonId) from i where i.dimension = z.dimension and n > 1) as n_items, m::bigint as n_answers, round(observed, 6) as observed, round(chance, 6) as chance, round((observed - chance) / (1 - chance), 6) as coefficient from z",
}
