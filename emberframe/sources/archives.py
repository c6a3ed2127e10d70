"""Archives: the files of zip archives as rows, from any store that Spark reads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def unzip(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, content of every file in the archives; what isn't an archive has no rows."""

    def run(batches):
        import io
        import zipfile

        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"], strict=True):
                if not zipfile.is_zipfile(io.BytesIO(data)):
                    continue
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame([(archive, info.filename, z.read(info))], columns=["archive", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, content binary")
