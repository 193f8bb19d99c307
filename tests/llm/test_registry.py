import os

import duckdb
import pytest

import corpus_pipeline
from folioscope.llm import registry
from folioscope.llm.common import shared_dir

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the bench tables are not here")


def test_one_query_for_each_operator():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(registry.oracle_sql()[name])
    found = registry.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(want.columns)
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(shown(r[c]) for c in want.columns) for r in found.collect()), key=str) == sorted((tuple(map(shown, r)) for r in want.fetchall()), key=str)


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows.count()
        rows = stage(spark, rows, DATA)
        assert rows.columns == docs.columns, name
        rows = rows.checkpoint()
        assert rows.count() <= before or name == "source mix"
    last = corpus_pipeline.STAGES[-1][1](spark, rows, DATA)
    assert last.count() == rows.count() > 0
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, whole.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, last.select("doc_id", "ids_sha256").collect()))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


class _Context:
    """A context without a setting, as far as the shared folder asks for it."""

    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = f"{folder}/of-this-context"


class _Session:
    def __init__(self, master):
        self.sparkContext, self.conf = _Context(master), {}


def test_the_shared_folder_without_a_setting():
    local = _Session("local[2]")
    made = shared_dir(local)
    assert made.endswith("/of-this-context") and shared_dir(local) == made
    cluster = _Session("spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
    cluster.sparkContext.folder = "hdfs://host/shared"
    assert shared_dir(cluster) == "hdfs://host/shared"
