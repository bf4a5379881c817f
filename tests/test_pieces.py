import pyarrow as pa

from pagewright.operators import entities as E
from pagewright.operators import words


def test_batches_are_taken_apart_in_pieces_of_bounded_bytes():
    texts = pa.array(["ab", None, "cde", "", "a text longer than a piece", "f"])
    made = list(words.pieces(texts, pa.array(range(6)), most=5))
    assert [(t.to_pylist(), n.to_pylist()) for t, n in made] == [(["ab", None, "cde", ""], [0, 1, 2, 3]), (["a text longer than a piece"], [4]), (["f"], [5])]
    assert list(words.pieces(texts.slice(0, 0))) == []


def test_extents_of_boxes_are_arrays_of_their_documents(spark):
    docs = words.as_document(spark.createDataFrame([(1, "a b  a"), (2, ""), (3, None)], "id int, text string"), "id", "text")
    made = {r["id"]: [tuple(x) for x in r["at"]] for r in docs.select("id", E.box_extents(docs["document"]).alias("at")).collect()}
    assert made == {1: [(0, 0, 1), (1, 2, 3), (2, 5, 6)], 2: [], 3: []}
    assert E.box_places("aXa", ["a", "X", "a", "a", ""]) == [0, 1, 2, -1, -1]
