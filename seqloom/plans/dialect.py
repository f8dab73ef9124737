"""Macros for what Spark SQL and DuckDB spell differently.

`@name(args)` in an operator's SQL expands per dialect; everything else in the
operators is common SQL.
"""

from __future__ import annotations

SPARK = {
    "epoch": "unix_timestamp({0})",
    "count_if": "count_if({0})",
    "sorted_set": "array_sort(collect_set({0}))",
    "json": "get_json_object({0}, '$.{1}')",
    "percentile": "percentile({0}, {1})",
    "log1p": "log1p({0})",
    "idiv": "({0} div {1})",
    "explode": "explode({0})",
    "range": "sequence({0}, {1})",
    "size": "cast(size({0}) as bigint)",
    "slice": "slice({0}, {1}, {2})",
    "any": "exists({0}, x -> {1})",
    "all": "forall({0}, x -> {1})",
    "map": "transform({0}, x -> {1})",
    "filter": "filter({0}, x -> {1})",
    "arg_min": "min_by({0}, struct({1}))",
    "arg_max": "max_by({0}, struct({1}))",
    "pack": "array_sort(collect_list(struct({0})))",
    "intersect": "array_intersect({0}, {1})",
    "union": "array_union({0}, {1})",
    "position": "cast(array_position({0}, {1}) as bigint)",
    "at": "element_at({0}, cast({1} as int))",
    "dot": "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (a, x) -> a + x)",
    "nan": "isnan({0})",
    "list": "collect_list({0})",
    "date": "cast(date_from_unix_date(cast(floor(({0}) / 86400.0) as int)) as string)",
    "md5": "md5(cast({0} as string))",
    "join": "array_join({0}, ',')",
    "ilog2": "log2({0})",
    "array": "array({0})",
    "strings": "transform({0}, x -> cast(x as string))",
    "slope": "regr_slope({0}, {1})",
    "contains": "array_contains({0}, {1})",
    "raise": "raise_error({0})",
}
DUCKDB = {
    "epoch": "cast(floor(epoch({0})) as bigint)",
    "count_if": "count(*) filter (where {0})",
    "sorted_set": "list_sort(list(distinct {0}))",
    "json": "({0}->>'$.{1}')",
    "percentile": "quantile_cont({0}, {1})",
    "log1p": "ln(1 + {0})",
    "idiv": "({0} // {1})",
    "explode": "unnest({0})",
    "range": "range({0}, {1} + 1)",
    "size": "cast(len({0}) as bigint)",
    "slice": "list_slice({0}, {1}, {1} + {2} - 1)",
    "any": "(len(list_filter({0}, lambda x: {1})) > 0)",
    "all": "(len(list_filter({0}, lambda x: {1})) = len({0}))",
    "map": "list_transform({0}, lambda x: {1})",
    "filter": "list_filter({0}, lambda x: {1})",
    "arg_min": "arg_min({0}, row({1}))",
    "arg_max": "arg_max({0}, row({1}))",
    "pack": "list_sort(list({{{0}}}))",
    "intersect": "list_intersect({0}, {1})",
    "union": "list_distinct(list_concat({0}, {1}))",
    "position": "cast(coalesce(list_position({0}, {1}), 0) as bigint)",
    "at": "list_extract({0}, cast({1} as bigint))",
    "dot": "list_dot_product(cast({0} as double[]), cast({1} as double[]))",
    "nan": "isnan({0})",
    "list": "list({0})",
    "date": "strftime(make_timestamp(cast(({0}) as bigint) * 1000000), '%Y-%m-%d')",
    "md5": "md5(cast({0} as varchar))",
    "join": "array_to_string({0}, ',')",
    "ilog2": "log2({0})",
    "array": "[{0}]",
    "strings": "list_transform({0}, lambda x: cast(x as varchar))",
    "slope": "regr_slope({0}, {1})",
    "contains": "list_contains({0}, {1})",
    "raise": "error({0})",
}
#: Macros whose arguments are one list, commas included.
WHOLE = {"array", "pack"}


def expand(sql: str, dialect: dict[str, str]) -> str:
    """sql with all macros expanded, innermost arguments first."""
    out, at = [], 0
    while (start := sql.find("@", at)) >= 0:
        out.append(sql[at:start])
        opening = sql.index("(", start)
        name, depth, args, first = sql[start + 1 : opening], 1, [], opening + 1
        at = first
        while depth:
            c = sql[at]
            depth += (c in "([") - (c in ")]")
            if depth == 0 or (c == "," and depth == 1 and name not in WHOLE and not (name in ("arg_min", "arg_max") and args)):
                args.append(expand(sql[first:at].strip(), dialect))
                first = at + 1
            at += 1
        if name == "pack" and dialect is DUCKDB:
            args = [", ".join(f"{c.strip()}: {c.strip()}" for c in args[0].split(","))]
        out.append(dialect[name].format(*args))
    out.append(sql[at:])
    return "".join(out)
