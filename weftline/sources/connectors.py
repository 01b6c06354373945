"""Connectors by type: options of Spark readers and writers, catalog probes, and JSON-lines and Markdown output."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: type: (family, format, URL pattern, driver class, default port); fixed values.
CONNECTORS = {
    "mysql": ("rdb", "jdbc", "jdbc:mysql://{host}:{port}/{db}", "com.mysql.cj.jdbc.Driver", 3306),
    "postgres": ("rdb", "jdbc", "jdbc:postgresql://{host}:{port}/{db}", "org.postgresql.Driver", 5432),
    "oracle": ("rdb", "jdbc", "jdbc:oracle:thin:@{host}:{port}/{db}", "oracle.jdbc.OracleDriver", 1521),
    "sqlserver": ("rdb", "jdbc", "jdbc:sqlserver://{host}:{port};databaseName={db}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "mariadb": ("rdb", "jdbc", "jdbc:mariadb://{host}:{port}/{db}", "org.mariadb.jdbc.Driver", 3306),
    "db2": ("rdb", "jdbc", "jdbc:db2://{host}:{port}/{db}", "com.ibm.db2.jcc.DB2Driver", 50000),
    "hive": ("mpp", "hive", "", "org.apache.hive.jdbc.HiveDriver", 10000),
    "impala": ("mpp", "jdbc", "jdbc:impala://{host}:{port}/{db}", "com.cloudera.impala.jdbc.Driver", 21050),
    "clickhouse": ("mpp", "jdbc", "jdbc:clickhouse://{host}:{port}/{db}", "com.clickhouse.jdbc.ClickHouseDriver", 8123),
    "starrocks": ("mpp", "jdbc", "jdbc:mysql://{host}:{port}/{db}", "com.mysql.cj.jdbc.Driver", 9030),
    "doris": ("mpp", "jdbc", "jdbc:mysql://{host}:{port}/{db}", "com.mysql.cj.jdbc.Driver", 9030),
    "mongodb": ("nosql", "mongodb", "mongodb://{host}:{port}/{db}", "", 27017),
    "redis": ("nosql", "redis", "redis://{host}:{port}/{db}", "", 6379),
    "elasticsearch": ("nosql", "es", "http://{host}:{port}", "", 9200),
    "hbase": ("nosql", "hbase", "{host}:{port}", "", 16000),
    "s3": ("storage", "parquet", "s3a://{db}", "", 9000),
    "hdfs": ("storage", "parquet", "hdfs://{host}:{port}/{db}", "", 8020),
    "ftp": ("storage", "parquet", "ftp://{host}:{port}/{db}", "", 21),
}


def options(kind: str, host: str = "", db: str = "", port: int | None = None, url: str | None = None, driver: str | None = None) -> dict[str, str]:
    """Reader options of a source; an own URL or driver goes before the built-in one."""
    _, fmt, pattern, built_in, usual = CONNECTORS[kind.lower()]
    out = {"format": fmt, "url": url or pattern.format(host=host, port=port or usual, db=db)}
    return out | ({"driver": driver or built_in} if fmt == "jdbc" else {})


def read(spark: SparkSession, table: str, **source: object) -> DataFrame:
    o = options(**source)
    fmt = o.pop("format")
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(**o, dbtable=table).load()
    if fmt == "hive":
        return spark.table(table)
    return spark.read.format(fmt).load(f"{o['url'].rstrip('/')}/{table}")


def copy(spark: SparkSession, source: DataFrame, table: str, mode: str = "append", **target: object) -> None:
    """Write a frame to a target table; ``mode`` as Spark's writers have it."""
    o = options(**target)
    fmt = o.pop("format")
    writer = source.write.mode(mode)
    if fmt == "jdbc":
        writer.format("jdbc").options(**o, dbtable=table).save()
    elif fmt == "hive":
        writer.insertInto(table) if mode == "append" else writer.saveAsTable(table)
    else:
        writer.format(fmt).save(f"{o['url'].rstrip('/')}/{table}")


def table_columns(spark: SparkSession, table: str, most: int = 2000) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(table)[:most]]


def addressed(sources: DataFrame, kind: str = "type", host: str = "host", port: str = "port", db: str = "db") -> DataFrame:
    """``sources`` with family, format, port (its own, or the usual one of its type) and url of each; those of an unknown type are left out."""
    known = sources.sparkSession.createDataFrame([(k, *v) for k, v in CONNECTORS.items()], "_type string, family string, format string, _url string, driver string, _port int")
    rows = sources.join(F.broadcast(known), F.lower(kind) == F.col("_type")).withColumn("_p", F.coalesce(F.col(port), F.col("_port")))  # a row a type
    url = F.col("_url")
    for mark, value in (("{host}", F.col(host)), ("{port}", F.col("_p").cast("string")), ("{db}", F.col(db))):
        url = F.replace(url, F.lit(mark), F.coalesce(value, F.lit("")))
    return rows.withColumn("_u", url).select(*(c for c in sources.columns if c not in ("family", "format", "url", port)), "family", "format", F.col("_p").alias(port), F.col("_u").alias("url"))


def existences(names: DataFrame, name: str = "name", database: str | None = None) -> DataFrame:
    """``names`` with state: PRESENT or ABSENT by the session's catalog (a database's tables and views, without case), UNKNOWN for all where it can't be asked."""
    spark = names.sparkSession
    try:
        there = [(t.name.lower(),) for t in spark.catalog.listTables(database)]
    except (PySparkException, Py4JJavaError):
        return names.withColumn("state", F.lit("UNKNOWN"))
    known = spark.createDataFrame(there, "_there string").distinct()
    return names.join(known, F.lower(name) == F.col("_there"), "left").withColumn("state", F.when(F.col("_there").isNotNull(), "PRESENT").otherwise("ABSENT")).drop("_there")


def existence(spark: SparkSession, table: str) -> str:
    """PRESENT, ABSENT, or UNKNOWN where the catalog can't say."""
    try:
        return "PRESENT" if spark.catalog.tableExists(table) else "ABSENT"
    except (PySparkException, Py4JJavaError):  # a remote catalog that fails, with an error of Spark's or of its driver's
        return "UNKNOWN"


def write_days(df: DataFrame, path: str, day: str = "biz_date") -> None:
    """Write days as partitions; those that ``df`` has replace what is there, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def retained(df: DataFrame, as_of: str, days: int = 90, day: str = "biz_date") -> DataFrame:
    """Rows of the last so many days."""
    return df.where(f"to_date({day}) >= date_sub(date '{as_of}', {days})")


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A table of at most ``rows`` rows."""
    got = df.limit(rows).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in got)])
