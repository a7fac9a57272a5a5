"""SQL that gives the rows of :mod:`utterscope.plans.queries` in DuckDB.

The statements follow the definitions (one mask per intent, one pass per metric) and not the way the
operators compute them.
"""

from __future__ import annotations

from utterscope.plans import queries as q
from utterscope.plans.views import BATCH_SQL, CORPUS_SQL, EMB_SQL, ENT_SQL, REPORT_PATHS_SQL


def _r(expression: str, digits: int = q.DIGITS) -> str:
    # Adding zero turns a negative zero into zero.
    return f"(round({expression}, {digits}) + 0.0)"


def _with(views: dict[str, str], body: str) -> str:
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in views.items()) + "\n" + body


def _ratio(numerator: str, denominator: str) -> str:
    return f"(case when {denominator} > 0 then cast({numerator} as double) / {denominator} else 0.0 end)"


# Intents: literal masks over all rows for each expected intent.
_INTENT_VIEWS = {
    "batch": BATCH_SQL,
    "rows_": "select report, lower(expected) as e, lower(matched) as m, result_type as t from batch",
    "known": """
      select report, lower(expected) as intent, max(expected) as display
      from batch where expected <> '' group by report, lower(expected)""",
    "counted": """
      select k.report, k.intent, k.display, count(*) as total,
        count(*) filter (where e = intent and t = 'TP') as plain_tp,
        count(*) filter (where m = intent and e is distinct from intent and t = 'FP') as plain_fp,
        count(*) filter (where e = intent and t = 'FN') as plain_fn,
        count(*) filter (where e = 'none' and t = 'TN') as none_tp,
        count(*) filter (where e is distinct from 'none' and m = 'none' and t = 'FN') as none_fp,
        count(*) filter (where e = 'none' and t = 'FP') as none_fn,
        count(*) filter (where e is distinct from 'none' and m is distinct from 'none'
                         and t is distinct from 'FN') as none_tn
      from known k join rows_ r on k.report = r.report
      group by k.report, k.intent, k.display""",
    "counts": """
      select report, intent, display, total, plain_tp, plain_fp, plain_fn,
        case when intent = 'none' then none_tp else plain_tp end as tp,
        case when intent = 'none' then none_fp else plain_fp end as fp,
        case when intent = 'none' then none_fn else plain_fn end as fn,
        case when intent = 'none' then none_tn else total - plain_tp - plain_fp - plain_fn end as tn
      from counted""",
}

_SCORED_VIEWS = {
    **_INTENT_VIEWS,
    "pr": f"""
      select report, display as intent, {_ratio("tp", "(tp + fp)")} as p, {_ratio("tp", "(tp + fn)")} as r,
        cast(tp + fn as double) as support, {_ratio("(tp + tn)", "total")} as accuracy
      from counts
      union all
      select report, 'micro', {_ratio("sum(plain_tp)", "sum(plain_tp + plain_fp)")},
        {_ratio("sum(plain_tp)", "sum(plain_tp + plain_fn)")},
        cast(sum(plain_tp + plain_fn) as double),
        {_ratio("(max(total) - sum(plain_fp) - sum(plain_fn))", "max(total)")}
      from counts group by report""",
    "scored": f"""
      select report, intent, p as precision, r as recall, {_ratio("2 * p * r", "(p + r)")} as f1,
        support, accuracy
      from pr""",
    "everything": """
      select * from scored
      union all
      select report, 'macro', avg(precision), avg(recall), avg(f1), avg(support), avg(accuracy)
      from scored where intent <> 'micro' group by report""",
}

# Entities.
_ENTITY_VIEWS = {
    "ent": ENT_SQL,
    "named": "select * from ent where entity is not null and entity <> ''",
    "methods": """
      select report, entity, engine,
        case when method like 'Full Match%' then 'Full Match'
             when method like 'Partial Match%' then 'Partial Match' else method end as method
      from named where engine is not null""",
    "totals": """
      select report, entity, engine, count(*) as n,
        count(*) * 100.0::double / sum(count(*)) over (partition by report, entity) as share
      from methods group by report, entity, engine""",
    "fine": """
      select report, entity, engine, method, count(*) as n,
        count(*) * 100.0::double / sum(count(*)) over (partition by report, entity, engine) as share
      from methods where method is not null group by report, entity, engine, method""",
}

# Text. White space is what a string method of Python takes for it: separators of any kind and these controls.
_SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
_CLEAN = rf"regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{_SPACE}]', '', 'g')"
_TOKENS = f"[t for t in regexp_split_to_array({_CLEAN}, '[{_SPACE}]+') if t <> '']"
_TEXT_VIEWS = {
    "corpus": CORPUS_SQL,
    "texts": f"select split, label, {_TOKENS} as tokens from corpus where text is not null",
    "words": "select split, label, unnest(tokens) as token from texts",
}
_VOCAB_VIEWS = {
    **_TEXT_VIEWS,
    "vocab": f"""
      select t.split, t.label, coalesce(any_value(v.size), 0) as vocab_size,
        cast(sum(len(t.tokens)) as bigint) as token_count
      from texts t left join (
        select split, label, count(distinct token) as size from words group by split, label) v
      on t.split = v.split and t.label = v.label
      group by t.split, t.label""",
}
_LENGTH_VIEWS = {
    **_TEXT_VIEWS,
    "lengths": """
      select label, split, 'sentence' as kind, cast(len(tokens) as integer) as x from texts
      union all
      select label, split, 'word', cast(length(token) as integer) from words""",
    "hist": """
      select label, kind, x, count(*) filter (where split = 'test') as n_test,
        count(*) filter (where split = 'train') as n_train
      from lengths group by label, kind, x""",
}
_SPLITS_VIEWS = {
    **_LENGTH_VIEWS,
    "steps": """
      select label, kind,
        abs(sum(n_test) over walk / sum(n_test) over whole - sum(n_train) over walk / sum(n_train) over whole)
          * coalesce(lead(x) over walk - x, 0) as moved,
        (n_test + 1e-9::double) / (sum(n_test) over whole + 1e-9::double * count(*) over whole) as p,
        (n_train + 1e-9::double) / (sum(n_train) over whole + 1e-9::double * count(*) over whole) as q
      from (select label, kind, x, cast(n_test as double) as n_test, cast(n_train as double) as n_train
            from hist) as h
      window whole as (partition by label, kind), walk as (partition by label, kind order by x)""",
    "both_splits": """
      select label from corpus where text is not null group by label having count(distinct split) = 2""",
}


def _kurtosis(split: str, kind: str) -> str:
    chosen = f"filter (where split = '{split}' and kind = '{kind}')"
    value = f"case when count(*) {chosen} > 3 then kurtosis_pop(x) {chosen} end"
    return f"{_r(value)} as {split}_{kind}_length_kurtosis"


# Embeddings.
_EMB_VIEWS = {
    "emb": EMB_SQL,
    "entries": """
      select id, split, label, unnest(vec) as x, generate_subscripts(vec, 1) as pos from emb""",
}


def _centroids(by: str) -> dict[str, str]:
    return {
        **_EMB_VIEWS,
        "cents": f"""
          select {by}, list(x order by pos) as c from (
            select {by}, pos, avg(cast(x as double)) as x from entries group by {by}, pos) as m
          group by {by}""",
    }


_SPLIT_CENTROIDS = _centroids("split, label")
_LABEL_CENTROIDS = _centroids("label")
_VEC = "cast(e.vec as double[])"


def _cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


_SIMILAR_VIEWS = {
    **_LABEL_CENTROIDS,
    "closeness": f"""
      select e.id, e.label, {_cosine(_VEC, "c.c")} as s
      from emb e join cents c on e.label = c.label""",
}
_PAIR_SQL = f"""
  select a.split, a.label as label1, b.label as label2, {_cosine("a.c", "b.c")} as s
  from cents a join cents b on a.split = b.split and a.label < b.label"""
_CROSS_SQL = f"""
  select a.label, {_cosine("a.c", "b.c")} as s
  from cents a join cents b on a.label = b.label
  where a.split = 'train' and b.split = 'test'"""


def _matrix(measure: str, digits: int = q.DIGITS) -> str:
    return _with(
        _LABEL_CENTROIDS,
        f"""select a.label as label1, b.label as label2, {_r(measure, digits)} as similarity
        from cents a, cents b""",
    )


# Planes: a symmetric matrix that is squared again and again turns into the projector on its first axis.
SQUARINGS = 22


def _axis(name: str, matrix: str) -> dict[str, str]:
    """Views ``{name}(pos, v)``, a unit vector whose largest element is positive, and ``{name}_share(value)``."""
    views = {f"{name}_0": f"select i, j, v / (select sum(v) from {matrix} where i = j) as v from {matrix}"}
    for k in range(SQUARINGS):
        views[f"{name}_p{k}"] = f"select a.i, b.j, sum(a.v * b.v) as v from {name}_{k} a join {name}_{k} b on a.j = b.i group by a.i, b.j"
        views[f"{name}_{k + 1}"] = f"select i, j, v / (select sum(v) from {name}_p{k} where i = j) as v from {name}_p{k}"
    last = f"{name}_{SQUARINGS}"
    column = f"(select arg_max(i, v) from {last} where i = j)"
    views[f"{name}_raw"] = f"select i as pos, v / sqrt(sum(v * v) over ()) as v from {last} where j = {column}"
    views[name] = f"select pos, v * sign((select arg_max(v, abs(v)) from {name}_raw)) as v from {name}_raw"
    views[f"{name}_share"] = f"""select sum(a.v * m.v * b.v) as value
      from {matrix} m join {name} a on a.pos = m.i join {name} b on b.pos = m.j"""
    return views


def _plane(points: str) -> dict[str, str]:
    """Views ``ax`` and ``ay`` (pos, v) for points given as (id, pos, x), and ``mean`` (pos, m)."""
    return {
        "points": points,
        "mean": "select pos, avg(x) as m from points group by pos",
        "centred": "select id, pos, x - m as x from points join mean using (pos)",
        "cov": """select a.pos as i, b.pos as j, sum(a.x * b.x) as v
          from centred a join centred b on a.id = b.id group by a.pos, b.pos""",
        **_axis("ax", "cov"),
        "rest": """select i, j, c.v - (select value from ax_share) * a.v * b.v as v
          from cov c join ax a on a.pos = c.i join ax b on b.pos = c.j""",
        **_axis("ay", "rest"),
    }


def _placed(keys: str, entries: str) -> str:
    """The points of a relation (keys, pos, x) in the plane."""
    return f"""select {keys}, sum((x - m) * ax.v) as x, sum((x - m) * ay.v) as y
      from ({entries}) as e join mean using (pos) join ax using (pos) join ay using (pos) group by {keys}"""


def _stored(views: dict[str, str], body: str) -> str:
    return "with " + ",\n".join(f"{name} as materialized ({sql})" for name, sql in views.items()) + "\n" + body


_ROW_ENTRIES = "select id, label, split, pos, cast(x as double) as x from entries"
_CENTROID_ENTRIES = "select {keys}, unnest(c) as x, generate_subscripts(c, 1) as pos from {cents}"
_LABEL_PLANE = {
    **_LABEL_CENTROIDS,
    **_plane("select id, pos, cast(x as double) as x from entries"),
    "row_points": _placed("id, label", _ROW_ENTRIES),
    "label_points": _placed("label", _CENTROID_ENTRIES.format(keys="label", cents="cents")),
    "projected": """select r.id, r.label, r.x, r.y, l.x as centroid_x, l.y as centroid_y,
      sqrt((r.x - l.x) ** 2 + (r.y - l.y) ** 2) as distance from row_points r join label_points l using (label)""",
}
_SHIFT_PLANE = {
    **_SPLIT_CENTROIDS,
    "shared": "select split, label, c from cents where label in (select label from cents group by label having count(*) = 2)",
    **_plane(f"""
      select cast(id as varchar) as id, pos, cast(x as double) as x from entries where label in (select label from shared)
      union all
      select concat(split, ':', label), pos, x from ({_CENTROID_ENTRIES.format(keys="split, label", cents="shared")}) as c"""),
    "ends": _placed("split, label", _CENTROID_ENTRIES.format(keys="split, label", cents="shared")),
}


# Scoring.
_LINE_Z = " + ".join(
    f"{weight}::double * {name}" for name, weight in q.LINE_WEIGHTS.items()
) + f" + {q.LINE_BIAS}::double"
_ACTIVATION_SQL = {
    "step": "case when z >= 0 then 1.0::double else 0.0::double end",
    "sigmoid": "1.0::double / (1.0::double + exp(-z))",
    "tanh": "tanh(z)",
    "relu": "greatest(0.0::double, z)",
    "leaky_relu": "case when z > 0 then z else 0.1::double * z end",
    "leaky_relu_max": "greatest(0.01::double * z, z)",
    "elu": "case when z > 0 then z else exp(z) - 1.0::double end",
    "swish": "z / (1.0::double + exp(-z))",
}


def _perceptron(activation: str) -> str:
    return f"""
      select l_orderkey, l_linenumber, {_r("z")} as z, {_r(_ACTIVATION_SQL[activation])} as y
      from (select l_orderkey, l_linenumber, {_LINE_Z} as z from lineitem) as scored"""


_VECTOR_WEIGHTS = "[" + ", ".join(f"{w}::double" for w in q.VECTOR_WEIGHTS) + "]"



def _stripped(expression: str) -> str:
    space = f"[{_SPACE}]+"
    bare = f"regexp_replace({expression}, '^{space}|{space}$', '', 'g')"
    return f"""regexp_replace({bare}, '^"+|"+$', '', 'g')"""


ORACLE: dict[str, str] = {
    "corpus_scan": _with({"corpus": CORPUS_SQL}, "select * from corpus where text is not null"),
    "report_metadata": f"""
      with parts as (
        select doc_id as report, regexp_split_to_array(text, '\r\n|\r|\n') as parts from documents),
      lines as (
        select report, unnest(parts) as line, generate_subscripts(parts, 1) as line_no from parts),
      pairs as (
        select report, line_no, {_stripped("substring(line, 1, instr(line, ',') - 1)")} as key,
          {_stripped("substring(line, instr(line, ',') + 1)")} as value
        from lines where instr(line, ',') > 0)
      select report, key, arg_max(value, line_no) as value from pairs group by report, key""",
    "model_name": f"""
      with paths as ({REPORT_PATHS_SQL}),
      stems as (select replace(replace(path, '/reports/', ''), '.csv', '') as stem from paths)
      select replace(stem, '_results', '') as report, split_part(stem, '_', 1) as model,
        count(*) as files
      from stems group by 1, 2""",
    "point_preview": """
      select doc_id, case when length(text) > 100 then concat(substring(text, 1, 100), '...')
                          else text end as preview
      from documents""",
    "intent_confusion": _with(
        _INTENT_VIEWS,
        """select report, e as expected, m as matched, t as result_type, count(*) as n
        from rows_ group by 1, 2, 3, 4""",
    ),
    "intent_display": _with(_INTENT_VIEWS, "select report, intent, display from known"),
    "intent_counts": _with(
        _INTENT_VIEWS, "select report, intent, display, tp, fp, fn, tn from counts"
    ),
    "intent_metrics": _with(
        _SCORED_VIEWS,
        "select report, intent, "
        + ", ".join(
            f"{_r(c)} as {c}" for c in ("precision", "recall", "f1", "support", "accuracy")
        )
        + " from everything",
    ),
    "report_rows": """
      select doc_id, nullif(regexp_replace(text, '\r\n|\r', '\n', 'g'), '') as utterance, nullif(lang, '') as expected,
        nullif(source, '') as matched, cast(null as varchar) as result_type, cast(null as varchar) as reject
      from documents""",
    "report_preamble": f'''
      select unnest(['Bot Name:', 'Threshold:', 'Notes:']) as key,
        unnest(['Bank', '5" pipe', 'a ""b""","c']) as value,
        (select count(distinct doc_id // {q.ROWS_PER_REPORT}) from documents) as reports''',
    "corpus_files": f"""
      select lang as label, regexp_replace(text, '\r\n|\r', '\n', 'g') as text, cast(null as varchar) as reject
      from documents where text <> ''
      union all select '{q.DAMAGED_LABEL}', null, 'a quoted cell is never closed'""",
    "json_round_trip": "select doc_id, text, lang, source from documents",
    "csv_round_trip": BATCH_SQL,
    "intent_order": _with(
        _SCORED_VIEWS,
        """select report, intent, row_number() over (partition by report order by
            case intent when 'micro' then 1 when 'macro' then 2 else 0 end, lower(intent)) as position
        from everything""",
    ),
    "entity_metrics": _with(
        _ENTITY_VIEWS,
        f"""
        select report, entity, {_r("count(*) filter (where correct) / count(*)::double")} as accuracy,
          count(*) as support
        from named group by report, entity
        union all
        select report, '', 1.0::double, count(*) filter (where entity is null or entity = '')
        from ent group by report
        union all
        select report, 'micro',
          {_r(_ratio("count(*) filter (where correct and entity <> '')", "count(*) filter (where entity <> '')"))},
          count(*)
        from ent group by report""",
    ),
    "entity_order": _with(
        _ENTITY_VIEWS,
        """
        select report, entity, row_number() over (partition by report order by kind, entity) as position
        from (
          select distinct report, entity, 0 as kind from named
          union all select distinct report, '', 1 from ent
          union all select distinct report, 'micro', 2 from ent) as listed""",
    ),
    "entity_breakdown_order": _with(
        _ENTITY_VIEWS,
        """
        select report, entity, method, category, sub_method, row_number() over (
          partition by report order by entity, engine_n desc, method, category, n desc, sub_method) as position
        from (
          select report, entity, engine as method, n, n as engine_n, 'EntityIdentifiedBy' as category,
            'Total' as sub_method from totals
          union all
          select f.report, f.entity, f.engine, f.n, t.n, 'entityIdentifiedUsing', f.method from fine f
          join totals t on t.report = f.report and t.entity = f.entity and t.engine = f.engine) as listed""",
    ),
    "entity_identification": _with(
        _ENTITY_VIEWS,
        f"""
        select report, entity, engine as method, n as count, {_r("share")} as percentage,
          'EntityIdentifiedBy' as category, 'Total' as sub_method
        from totals
        union all
        select report, entity, engine, n, {_r("share")}, 'entityIdentifiedUsing', method from fine""",
    ),
    "entity_engine_summary": _with(
        _ENTITY_VIEWS,
        f"select report, entity, engine, n as count, {_r('share')} as percentage from totals",
    ),
    "entity_methods": _with(
        _ENTITY_VIEWS,
        f"select report, entity, engine, method, n as count, {_r('share')} as percentage from fine",
    ),
    "utterance_success": _with(
        _ENTITY_VIEWS,
        f"""
        select report, 'utterance_level_success' as metric,
          {_r("avg(case when good then 1.0::double else 0.0::double end)")} as value
        from (select report, utterance, bool_and(coalesce(correct, false)) as good
              from named where utterance is not null group by report, utterance) as u
        group by report""",
    ),
    "token_counts": _with(
        _TEXT_VIEWS,
        """
        select split, label, token, count(*) as occurrences from words group by 1, 2, 3
        union all
        select distinct split, label, cast(null as varchar), 0 from texts where len(tokens) = 0""",
    ),
    "vocab_ttr": _with(
        _VOCAB_VIEWS,
        f"""select split, label, vocab_size, token_count,
          {_r(_ratio("vocab_size", "token_count"))} as type_token_ratio from vocab""",
    ),
    "vocab_sketches": _with(
        _TEXT_VIEWS,
        """select split, label, count(distinct token) as vocab_size, true as is_close
        from words group by grouping sets ((split, label), (split), ())""",
    ),
    "ttr_split_diff": _with(
        _VOCAB_VIEWS,
        f"""
        select a.label, {_r(_ratio("a.vocab_size", "a.token_count"))} as test_ttr,
          {_r(_ratio("b.vocab_size", "b.token_count"))} as train_ttr,
          {_r(f'abs({_ratio("a.vocab_size", "a.token_count")} - {_ratio("b.vocab_size", "b.token_count")})')}
            as type_token_ratio_diff
        from vocab a join vocab b on a.label = b.label
        where a.split = 'test' and b.split = 'train'""",
    ),
    "label_union": _with(
        _TEXT_VIEWS,
        """select label from corpus where split = 'test' union
        select label from corpus where split = 'train'""",
    ),
    "label_intersect": _with(
        _TEXT_VIEWS,
        """select label from corpus where split = 'test' intersect
        select label from corpus where split = 'train'""",
    ),
    "text_embed_hash": _with(
        {
            **_TEXT_VIEWS,
            "docs": f"select doc_id, split, label, {_TOKENS} as tokens from corpus where text is not null",
            "digests": "select doc_id, split, label, md5(token) as m from (select *, unnest(tokens) as token from docs) as t",
            "counted": f"""
              select doc_id, split, label, cast(cast('0x' || m[1:8] as bigint) % {q.encoding.DIMENSIONS} as integer) as pos,
                sum(1 - 2 * ((instr('0123456789abcdef', m[9]) - 1) % 2)) as c
              from digests group by all""",
            "held": "select pos, ln((select count(*) from docs) + 1.0::double) - ln(count(*) + 1.0::double) as w from counted group by pos",
        },
        f"""select doc_id, split, label, pos, {_r("cast(cast(c * w as float) as double)")} as value
        from counted join held using (pos) where cast(c * w as float) <> 0""",
    ),
    "length_histogram": _with(_LENGTH_VIEWS, "select label, kind, x, n_test, n_train from hist"),
    "length_stats": _with(
        _LENGTH_VIEWS,
        f"""select label, split, kind, count(*) as n, {_r("avg(x)")} as mean, min(x) as min, max(x) as max
        from lengths group by label, split, kind""",
    ),
    "length_kurtosis": _with(
        _LENGTH_VIEWS,
        "select label, "
        + ", ".join(_kurtosis(s, k) for s in ("test", "train") for k in ("sentence", "word"))
        + " from lengths group by label",
    ),
    "length_emd": _with(
        _SPLITS_VIEWS,
        f"""
        select label, {_r("sum(moved) filter (where kind = 'sentence')")} as emd_sentence_length,
          {_r("sum(moved) filter (where kind = 'word')")} as emd_word_length
        from steps where label in (select label from both_splits) group by label""",
    ),
    "length_js": _with(
        _SPLITS_VIEWS,
        f"""
        select label, {_r("sum(t) filter (where kind = 'sentence')")} as js_sentence_length,
          {_r("sum(t) filter (where kind = 'word')")} as js_word_length
        from (select label, kind, 0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q)) as t
              from steps) as terms
        where label in (select label from both_splits) group by label""",
    ),
    "centroids": _with(
        _EMB_VIEWS,
        f"""
        select split, label, count(*) as n, cast(pos - 1 as integer) as pos,
          {_r("avg(cast(x as double))")} as value
        from entries group by split, label, pos""",
    ),
    "cohesion": _with(
        _SPLIT_CENTROIDS,
        f"""
        select e.split, e.label, {_r(f'avg({_cosine(_VEC, "c.c")})')} as cohesion, count(*) as n
        from emb e join cents c on e.split = c.split and e.label = c.label
        group by e.split, e.label""",
    ),
    "cohesion_stats": _with(
        _SIMILAR_VIEWS,
        f"""
        select label, {_r("avg(s)")} as mean, {_r("median(s)")} as median, {_r("stddev_pop(s)")} as std
        from closeness group by label""",
    ),
    "cohesion_scaled": _with(
        _SIMILAR_VIEWS,
        f"""
        select id, label, {_r("s")} as similarity,
          {_r('''case when (select max(s) > min(s) from closeness)
            then (s - (select min(s) from closeness))
              / ((select max(s) from closeness) - (select min(s) from closeness)) else s end''')} as scaled
        from closeness""",
    ),
    "centroid_pairs": _with(
        _SPLIT_CENTROIDS,
        f"select split, label1, label2, {_r('s')} as similarity from ({_PAIR_SQL}) as pairs",
    ),
    "similarity_edges": _with(
        _SPLIT_CENTROIDS,
        f"""select split, label1, label2, {_r('s')} as similarity from ({_PAIR_SQL}) as pairs
        where s >= {q.EDGE_THRESHOLD}""",
    ),
    "centroid_cross_split": _with(
        _SPLIT_CENTROIDS,
        f"select label, {_r('s')} as cross_similarity from ({_CROSS_SQL}) as crossed",
    ),
    "split_consistency": _with(
        _SPLIT_CENTROIDS,
        f"""select label, {_r('s')} as similarity, {_r('s')} as consistency,
          row_number() over (order by s desc, label) as position
        from ({_CROSS_SQL}) as crossed where s is not null and isfinite(s)""",
    ),
    "distinctiveness_cosine": _matrix(_cosine("a.c", "b.c")),
    "distinctiveness_euclidean": _matrix("1.0::double / (1.0::double + list_distance(a.c, b.c))"),
    "distinctiveness_rounded": _matrix(_cosine("a.c", "b.c"), 2),
    "nearest_centroid": _with(
        _LABEL_CENTROIDS,
        f"""
        select id, label, best.nearest as nearest, {_r("best.d")} as distance
        from (
          select e.id, e.label,
            min({{'d': 1 - {_cosine(_VEC, "c.c")}, 'nearest': c.label}}) as best
          from emb e, cents c group by e.id, e.label) as ranked""",
    ),
    "pca_projection": _stored(
        _LABEL_PLANE,
        "select id, label, " + ", ".join(
            f"{_r(c)} as {c}" for c in ("x", "y", "centroid_x", "centroid_y", "distance")) + " from projected",
    ),
    "pca_ranges": _stored(
        _LABEL_PLANE,
        f"""select label, {_r("min(x)")} as x_min, {_r("max(x)")} as x_max, {_r("min(y)")} as y_min,
          {_r("max(y)")} as y_max from projected group by label""",
    ),
    "pca_explained_variance": _stored(
        _LABEL_PLANE,
        f"""select component::integer as component,
          {_r("value / (select sum(v) from cov where i = j)")} as explained_variance_ratio
        from (select 1 as component, value from ax_share union all select 2, value from ay_share) as shares""",
    ),
    "centroid_shift": _stored(
        _SHIFT_PLANE,
        f"""select a.label, {_r("a.x")} as x1, {_r("a.y")} as y1, {_r("b.x")} as x2, {_r("b.y")} as y2,
          {_r("sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)")} as shift
        from ends a join ends b on a.label = b.label where a.split = 'train' and b.split = 'test'""",
    ),
    "centroid_shift_points": _stored(
        _SHIFT_PLANE,
        f"""select id, split, label, {_r("x")} as x, {_r("y")} as y from (
          {_placed("id, split, label", _ROW_ENTRIES + " where label in (select label from shared)")}) as placed""",
    ),
    "centroid_plane": _stored(
        {
            **_LABEL_CENTROIDS,
            **_plane(f"select label as id, pos, x from ({_CENTROID_ENTRIES.format(keys='label', cents='cents')}) as c"),
        },
        f"""select label, {_r("x")} as x, {_r("y")} as y from (
          {_placed("label", _CENTROID_ENTRIES.format(keys="label", cents="cents"))}) as placed""",
    ),
    "label_sample": _with(
        {"emb": EMB_SQL},
        f"""
        select id, split, label, rank from (
          select id, split, label, row_number() over (
            partition by split, label
            order by md5('{q.SAMPLE_SEED}:' || cast(id as varchar)), id)::integer as rank
          from emb) as ranked
        where rank <= {q.SAMPLE_SIZE}""",
    ),
    **{f"perceptron_{name}": _perceptron(name) for name in q.SCORED_ACTIVATIONS},
    "activation_summary": _with(
        {
            "emb": EMB_SQL,
            "scored": f"""
              select split, label,
                tanh(list_inner_product(cast(vec as double[]), {_VECTOR_WEIGHTS}) + {q.VECTOR_BIAS}::double) as y
              from emb""",
        },
        f"""
        select split, label, count(y) as n, {_r("avg(y)")} as mean, {_r("min(y)")} as min,
          {_r("max(y)")} as max,
          {_r("avg(case when y > 0 then 1.0::double else 0.0::double end)")} as positive_share
        from scored group by split, label""",
    ),
}
