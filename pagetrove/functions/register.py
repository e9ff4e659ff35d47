"""The same functions for SQL users."""

from pyspark.sql import SparkSession

from pagetrove.functions.fuzzy import partial_ratio_udf
from pagetrove.functions.urls import HOST_PATTERN, PATH_PATTERN, UNSAFE_CHAR
from pagetrove.session import ship_package

SQL_FUNCTIONS = {
    "host_of": f"(url STRING) RETURNS STRING RETURN lower(nullif(regexp_extract(url, r'{HOST_PATTERN}', 1), ''))",
    "path_of": (
        f"(url STRING) RETURNS STRING RETURN coalesce(nullif(array_join(transform(split(regexp_extract(url, r'{PATH_PATTERN}', 1), ''),"
        f" c -> if(c = ' ', '%20', if(c rlike r'{UNSAFE_CHAR}', url_encode(c), c))), ''), ''), '/')"
    ),
    "site_of": r"(host STRING) RETURNS STRING RETURN substring_index(regexp_replace(host, r'^www\.', ''), '.', -2)",
    "strip_citations": r"(t STRING) RETURNS STRING RETURN regexp_replace(t, r'\[\d+\]', '')",
    "breadcrumb_of": (
        "(url STRING) RETURNS STRING RETURN aggregate(slice(split(path_of(url), '/'), 1, 3),"
        " named_struct('t', host_of(url), 'done', false),"
        " (a, p) -> if(a.done OR p rlike r'\\.(html|htm|php|asp)$', named_struct('t', a.t, 'done', true),"
        " if(length(if(p = '', a.t, a.t || ' › ' || p)) > 50, named_struct('t', a.t || ' › ...', 'done', true),"
        " named_struct('t', if(p = '', a.t, a.t || ' › ' || p), 'done', false))),"
        " a -> a.t)"
    ),
}


def register_functions(spark: SparkSession) -> None:
    """Create ``host_of``, ``path_of``, ``site_of``, ``strip_citations`` and ``breadcrumb_of``, and the
    fuzzy matcher as ``partial_ratio``."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    ship_package(spark)
    spark.udf.register("partial_ratio", partial_ratio_udf())
