"""Streams over files: late files, and batches that run twice."""

from __future__ import annotations

from titleloom.operators.catalogue import build_catalogue
from titleloom.operators.normalize import Steps
from titleloom.session import CHECKPOINT_CONF, new_shared_path, shared_folder
from titleloom.streaming import titles as st

STEPS = Steps(correct_typos=False)


def test_each_run_takes_the_files_that_are_new(spark, lists, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([(1, "Advogadas Sr")], "id int, title string").write.parquet(source)
    for expected in ({"advogado senior"}, {"advogado senior", "medico"}):
        stream = st.read_title_stream(spark, source, "id int, title string")
        st.normalize_stream(stream, lists, out, state).awaitTermination()
        assert {r.norm_title for r in spark.read.parquet(out).collect()} == expected
        spark.createDataFrame([(2, "Médica")], "id int, title string").write.mode("append").parquet(source)


def test_the_last_batch_of_a_key_counts(spark, lists, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    roles = spark.createDataFrame([(2, "Advogado", "main"), (3, "Médico", "main")], "role_id int, title string, source string")
    catalogue = build_catalogue(roles, lists)
    for rows in ([(1, "advogada"), (2, "nada"), (3, "medica")], [(1, "medico"), (4, "Lawyer")]):
        spark.createDataFrame(rows, "id int, title string").write.mode("append").parquet(source)
        stream = st.read_title_stream(spark, source, "id int, title string")
        st.match_stream(stream, ["id"], catalogue, lists, out, state, STEPS).awaitTermination()
    found = {r.id: r.cargo_id for r in st.current_flags(spark, out, ["id"]).collect()}
    assert found == {1: 3, 3: 3, 4: 2}


def test_a_batch_that_runs_again_replaces_its_rows(spark, lists, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    catalogue = build_catalogue(spark.createDataFrame([(2, "Advogado", "main")], "role_id int, title string, source string"), lists)
    spark.createDataFrame([(1, "advogada")], "id int, title string").write.parquet(source)
    for state in ("lost", "new"):  # the second run knows nothing of the first
        stream = st.read_title_stream(spark, source, "id int, title string")
        st.match_stream(stream, ["id"], catalogue, lists, out, str(tmp_path / state), STEPS).awaitTermination()
    assert spark.read.parquet(out).count() == 1


class Session:
    """Just enough of a session to see which folder is chosen."""

    def __init__(self, named):
        self.named, self.folder = named, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.named if key == CHECKPOINT_CONF else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_the_shared_folder_is_the_one_the_cluster_names():
    named = Session("hdfs://all/see/")
    assert shared_folder(named) == "hdfs://all/see" and named.folder == "hdfs://all/see/"
    assert new_shared_path(named, "x").startswith("hdfs://all/see/x-")
    unnamed = Session(None)
    assert shared_folder(unnamed) == unnamed.folder == shared_folder(unnamed)
