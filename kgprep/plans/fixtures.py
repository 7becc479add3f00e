"""Writers of file layouts that the scans expect, used to build query and
test inputs from DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_language_tree(lines: DataFrame, root: str, suffix: str = ".ttl.bz2") -> None:
    """Write ``(language, dataset, value)`` lines as
    ``<root>/<language>/<dataset>_<language>.ttl.bz2``, each a Hadoop output
    directory of bzip2 part files (the scan reads a file or such a directory).

    One Spark write partitioned by language and dataset, with no shuffle by
    them, so a pair holding a third of the rows is written by every task
    that holds some of it.  Each partition directory is then renamed into
    the tree through the Hadoop FileSystem of the target path.
    """
    spark = lines.sparkSession
    staging = root.rstrip("/") + "_staging"
    (lines.sortWithinPartitions("language", "dataset").write.mode("overwrite")
     .partitionBy("language", "dataset").option("compression", "bzip2").text(staging))
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(staging)
    fs = path.getFileSystem(conf)
    for lang_dir in fs.listStatus(path):
        name = lang_dir.getPath().getName()
        if not lang_dir.isDirectory() or not name.startswith("language="):
            continue
        language = name.split("=", 1)[1]
        for ds_dir in fs.listStatus(lang_dir.getPath()):
            dataset = ds_dir.getPath().getName().split("=", 1)[1]
            target = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{language}/{dataset}_{language}{suffix}")
            fs.mkdirs(target.getParent())
            fs.rename(ds_dir.getPath(), target)
