import pytest

from pagewright import queries

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    made = queries.QUERIES[name](spark, SF).toPandas()
    assert oracle.rows(made) == oracle.rows(duck.execute(queries.ORACLES[name]).df())


def test_every_query_without_sql_is_known():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert len(queries.QUERIES) > 60


@pytest.mark.parametrize("name", ["pattern_entities", "ner_consistency", "ner_merger", "join_fragments", "merge_overlapping", "dedupe_readings"])
def test_larger_tables_match_sql(spark, name):
    larger = SF.replace("0.001", "0.01")
    assert oracle.rows(queries.QUERIES[name](spark, larger).toPandas()) == oracle.rows(oracle.connect(larger).execute(queries.ORACLES[name]).df())


def test_streamed_pages_equal_the_batch(spark):
    assert [tuple(r) for r in queries.stream_equals_batch(spark, SF).collect()] == [("rows", 200)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["label", "source", "n", "n_docs", "mean_score"]


@pytest.mark.parametrize("name", ["dbnet_stage", "yolo_stage", "embedded_images_stage", "text_layer_stage", "probability_quads", "word_spans", "image_boxes"])
def test_work_on_pixels_is_dealt_to_all_cores(spark, name):
    found = queries.QUERIES[name](spark, SF)  # the tables are one small file each
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_streamed_files_grow_in_number_with_the_input(spark, monkeypatch, tmp_path):
    from pagewright.sources import shared

    monkeypatch.setattr(shared, "workspace", lambda session, name: str(tmp_path / name))
    queries.stream_equals_batch(spark, SF).collect()
    assert len(list((tmp_path / "stream" / "in").glob("*.parquet"))) > 6
    assert len(list((tmp_path / "stream" / "out").glob("batch=*"))) in (3, 4)
