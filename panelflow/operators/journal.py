"""A journal of provider answers: what was answered is on shared storage before the next request goes out.

A retried task, a lost executor or a job that runs again finds the answers and asks only for the rest.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.sources.files import open_files

BINS = 256
BATCH_ROWS = 64


class _Bin:
    """Answers of one bin of keys: files in a folder, each written under another name first."""

    def __init__(self, folder: str):
        self.fs, self.path = open_files(folder)
        self.fs.create_dir(self.path, recursive=True)

    def read(self) -> pd.DataFrame | None:
        found = [f.path for f in self.fs.get_file_info(files.FileSelector(self.path)) if f.base_name.endswith(".arrow")]
        tables = [pa.ipc.open_file(self.fs.open_input_file(f)).read_all() for f in sorted(found)]
        return pa.concat_tables(tables).to_pandas() if tables else None

    def write(self, answers: pd.DataFrame, kind: pa.Schema) -> None:
        held, name = io.BytesIO(), uuid.uuid4().hex
        table = pa.Table.from_pandas(answers, schema=kind, preserve_index=False)
        with pa.ipc.new_file(held, kind) as out:
            out.write_table(table)
        draft = posixpath.join(self.path, f".{name}")
        with self.fs.open_output_stream(draft) as out:
            out.write(held.getvalue())
        self.fs.move(draft, posixpath.join(self.path, f"{name}.arrow"))


def journaled(requests: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], kind: str, journal: str,
              key: str = "key", bins: int = BINS, rows: int = BATCH_ROWS, parallelism: int | None = None) -> DataFrame:
    """Answers of a provider that is asked once per key: ``provider`` over requests as ``mapInPandas`` would call it, with
    results of schema ``kind`` that name their request in ``key``.

    journal is a folder on storage that all executors share. Requests are dealt to ``bins`` by their key, and a bin is
    worked off by one task, ``rows`` requests at a time. An answered batch is in the journal before the next one is asked,
    so a failure asks at most one batch of a task again, and a batch whose answers were written never. A request
    without an answer leaves a row with the key alone in the journal and none in the result. With speculative execution two
    attempts could ask at the same time; leave it off for such jobs.
    """
    spark = requests.sparkSession
    schema = spark.createDataFrame([], kind).schema
    arrow = pa.schema([pa.field(f.name, pa.string() if f.dataType.simpleString() == "string" else pa.float64() if f.dataType.simpleString() == "double"
                                else pa.int64() if f.dataType.simpleString() in ("long", "bigint") else pa.bool_()) for f in schema.fields])
    marked = arrow.append(pa.field("__answered", pa.bool_()))
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, store, known = None, None, None
        for batch in batches:
            for bin_number, part in batch.groupby("__bin", sort=True):
                if bin_number != number:
                    number, store = bin_number, _Bin(f"{journal}/bin={bin_number}")
                    known = store.read()
                asked = part.drop(columns="__bin")
                if known is not None:
                    mine = known[known[key].isin(asked[key])]
                    yield mine[mine["__answered"]][names]
                    asked = asked[~asked[key].isin(mine[key])]
                for at in range(0, len(asked), rows):
                    some = asked.iloc[at:at + rows]
                    got = [a for a in provider(iter([some.reset_index(drop=True)]))]
                    answers = pd.concat(got)[names].assign(__answered=True) if got else pd.DataFrame(columns=[*names, "__answered"])
                    silent = some[~some[key].isin(answers[key])][[key]].assign(__answered=False)
                    store.write(pd.concat([answers, silent]).reindex(columns=[*names, "__answered"]), marked)
                    if len(answers):
                        yield answers[names]

    dealt = requests.withColumn("__bin", F.pmod(F.xxhash64(key), F.lit(bins)).cast("int"))
    spread = dealt.repartition(parallelism, "__bin") if parallelism else dealt.repartition("__bin")
    return spread.sortWithinPartitions("__bin", key).mapInPandas(run, kind)
