"""Business-record views over the star-schema tables: the same SQL runs in Spark and, as oracle, in DuckDB.

customers: labelled, with typos, reordered words, missing fields and decoys. documents: Unicode text with natural copies.
parts: few distinct names, many-to-many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PLACE = "FROM {customer} customer JOIN {nation} nation ON c_nationkey = n_nationkey JOIN {region} region ON r_regionkey = n_regionkey"
_LOT = "(c_custkey % 900 + 1)"

CUSTOMERS = {
    "src1": f"""SELECT 'S1-' || c_custkey AS entity_id, c_name || ' & Sons Inc' AS business_name,
        {_LOT} || ' ' || c_mktsegment || ' St, ' || n_name AS business_address, r_name AS country {_PLACE}""",
    "src2": f"""SELECT 'S2-' || c_custkey AS entity_id,
        CASE c_custkey % 4 WHEN 0 THEN upper(c_name) || ' AND SONS, INC.' WHEN 1 THEN c_name || ' and Sons Incorporated'
             WHEN 2 THEN replace(c_name, 'Customer', 'Custmer') || ' & Sons Inc' ELSE 'Sons and ' || c_name || ' Inc' END AS business_name,
        CASE WHEN c_custkey % 30 = 1 THEN NULL WHEN c_custkey % 7 = 0 THEN {_LOT} || ' ' || c_mktsegment || ' Street, ' || n_name
             ELSE {_LOT} || ' ' || c_mktsegment || ' St., ' || n_name END AS business_address,
        CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'ATLANTIS' ELSE r_name END AS country {_PLACE}
        WHERE c_custkey % 3 <> 0
        UNION ALL SELECT 'S2-D' || c_custkey, c_name || ' & Sons Inc', {_LOT} || ' ' || c_mktsegment || ' St, ' || n_name, r_name {_PLACE}
        WHERE c_custkey % 17 = 0""",
    "src3": f"""SELECT 'S3-' || c_custkey AS entity_id,
        CASE WHEN c_custkey % 2 = 0 THEN c_name || '  and  sons inc' ELSE c_name END AS business_name,
        CASE WHEN c_custkey % 30 = 2 THEN NULL ELSE {_LOT} || ', ' || c_mktsegment || ' ST ' || n_name END AS business_address,
        r_name AS country {_PLACE} WHERE c_custkey % 5 <> 0""",
    "truth_links": """SELECT 'S1-' || c_custkey AS sid, 'S2-' || c_custkey AS tid FROM {customer} customer WHERE c_custkey % 3 <> 0
        UNION ALL SELECT 'S1-' || c_custkey, 'S3-' || c_custkey FROM {customer} customer WHERE c_custkey % 5 <> 0""",
}


def _thirds(table: str, key: str, name: str, address: str, country: str) -> dict[str, str]:
    return {f"src{i + 1}": f"SELECT 'S{i + 1}-' || {key} AS entity_id, {name} AS business_name, {address} AS business_address, {country} AS country FROM {{{table}}} {table} WHERE {key} % 3 = {i}" for i in range(3)}


DOCUMENTS = _thirds("documents", "doc_id", "text", "text", "lang")
PARTS = _thirds("part", "p_partkey", "p_name", "p_brand || ' ' || p_type", "CAST(p_size % 3 AS VARCHAR(9))")
TABLES = ("customer", "nation", "region", "documents", "part")


def views(spark: SparkSession, sf_dir: str, kind: dict[str, str]) -> dict[str, DataFrame]:
    """The views of a fixture as DataFrames, by name."""
    out = {}
    for name, sql in kind.items():
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
        out[name] = spark.sql(sql, **used)
    return out


def ctes(kind: dict[str, str]) -> str:
    """The views as common table expressions for DuckDB."""
    plain = {t: t for t in TABLES}
    return ",\n".join(f"{name} AS ({sql.format(**plain)})" for name, sql in kind.items())
