import pytest

from pagewright.functions.countries import Countries
from pagewright.functions.fuzzy import FuzzyPattern
from pagewright.operators import patterns as P

FOUND = [
    ("Card: 5500 0000 0000 0004.", "CREDIT_CARD", "5500 0000 0000 0004"),
    ("Card 5500 0lOO 0000 0004", None, None),
    ("Amex 3714 496353 98431", "CREDIT_CARD", "3714 496353 98431"),
    ("PESEL: 44051401359", "PESEL", "44051401359"),
    ("PESEL 44O514O1359", "PESEL", "44O514O1359"),
    ("SSN 123-45-6789", "SSN", "123-45-6789"),
    ("SSN 123 – 45 – 678g", "SSN", "123 – 45 – 678g"),
    ("mail anna.nowak@example.org now", "EMAIL", "anna.nowak@example.org"),
    ("mail anna.nowak @ example .org now", "EMAIL", "anna.nowak @ example .org"),
    ("mail anna©example.org", "EMAIL", "anna©example.org"),
    ("Tel. +48 600-l23-456", "PHONE", "+48 600-l23-456"),
    ("Tel. (555) 123-4567", "PHONE", "(555) 123-4567"),
    ("Date 12.03.2024", "DATE", "12.03.2024"),
    ("Date 2024-03-12", "DATE", "2024-03-12"),
    ("born 12 stycznia 2024 in", "DATE", "12 stycznia 2024"),
    ("on Jan. 12, 2024 we", "DATE", "Jan. 12, 2024"),
    ("on 3rd of March 2021", "DATE", "3rd of March 2021"),
    ("valid until 10/2024", "DATE", "10/2024"),
    ("since October 2024", "DATE", "October 2024"),
    ("see https://example.com/docs?x=1#y.", "URL", "https://example.com/docs?x=1#y"),
    ("visit www.example.pl today", "URL", "www.example.pl"),
    ("at http ://example.com/a)", "URL", "http ://example.com/a"),
    ("ul. Prosta 1, 00-950 Warszawa", "ZIP_CODE", "00-950"),
    ("New York, NY 10001", "ZIP_CODE", "10001"),
    ("ZIP 94105-1234", "ZIP_CODE", "94105-1234"),
    ("10115 Berlin", "ZIP_CODE", "10115"),
    ("London SW1A 1AA", "ZIP_CODE", "SW1A 1AA"),
    ("Ottawa ON K1A 0B1", "ZIP_CODE", "K1A 0B1"),
    ("IBAN: DE89 3704 0044 0532 0130 00.", "IBAN", "DE89 3704 0044 0532 0130 00"),
    ("GB29 NWBK 6016 1331 9268 19", "IBAN", "GB29 NWBK 6016 1331 9268 19"),
    ("nr 61 1090 1014 0000 0712 1981 2874", "IBAN", "61 1090 1014 0000 0712 1981 2874"),
]
NOTHING = ["SOS Bill is lOl", "Page 3 of 12", "In 2024 we grew", "Version 1.2.3.4", "Date 45.13.2024", "Invoice 2024/03/118", "12345 Main Street", "Model XY12 ABCD EFGH", "FV 3/2024", "period 13/2024", "code 10/3024", ""]


@pytest.mark.parametrize(("text", "label", "word"), [f for f in FOUND if f[1]])
def test_finds(text, label, word):
    assert [(f.label, text[f.start : f.end]) for f in P.find_matches(text)] == [(label, word)]


@pytest.mark.parametrize("text", NOTHING)
def test_finds_nothing(text):
    assert P.find_matches(text) == []


def test_failed_checks_score_low():
    assert P.find_matches("SSN 000-12-3456") == []
    assert P.find_matches("SSN 000-12-3456", threshold=0)[0].label == "SSN"
    assert P.find_matches("mail a @ b.com", labels=("EMAIL",), tolerant=False) == []


def test_normalise_keeps_length():
    for text in ("12–34—56", "4111 1lll 1111 1111", "Bill SOS 1st", "O0O 1I1"):
        assert len(P.normalise(text)[0]) == len(text)
    assert P.normalise("12–34")[0] == "12-34" and P.normalise("1st")[0] == "1st" and P.normalise("4111 1lll 1111")[0] == "4111 1111 1111"


def test_library_engines_yield_to_whole_readings():
    part = lambda text: [(7, 15, 0.95)]
    assert [f.start for f in P.find_matches("T (555) 123-4567", labels=("PHONE",), find_phones=part)] == [2]


def test_countries():
    c = Countries({"Poland": "PL", "New Zealand": "NZ", "Chad": "TD"}, {"POL": "PL", "ARE": "AE", "NZL": "NZ", "TCD": "TD", "USA": "US"})
    assert c.find("in Poland, New Zealand")[0][:4] == (3, 9, "PL", 0.75)
    assert [f[2] for f in c.find("in Poland, New Zealand")] == ["PL", "NZ"]
    assert c.find("Chad said") == [(0, 4, "TD", 0.4, True)] and c.find("Country of birth: Chad")[0][3] == 0.9
    assert c.find("Polandish US") == [] and c.find("Country: US")[0][3] == 0.85


class TestFuzzy:
    ssn = FuzzyPattern(r"\d{3}-\d{2}-\d{4}")

    def test_edits(self):
        assert self.ssn.match_all("123-45-678X") == []
        (m,) = self.ssn.match_all("123-45-678X", 1)
        assert (m.start, m.end, m.cost, m.edits) == (0, 11, 1, (("substitute", 10),))
        (m,) = self.ssn.match_all("123-45-67,89", 1)
        assert (m.start, m.end, m.edits) == (0, 12, (("insert", 9),))
        (m,) = self.ssn.match_all("123-45-678 ", 1, substitute=9, insert=9)
        assert (m.start, m.end, [k for k, _ in m.edits]) == (0, 10, ["delete"])
        assert self.ssn.match_all("12X-45-67Y9", 1) == [] and self.ssn.match_all("12X-45-67Y9", 2)[0].cost == 2
        (m,) = self.ssn.match_all("..123-45-6789..", 2)
        assert (m.start, m.end, m.cost) == (2, 13, 0)

    def test_bounds(self):
        text = "9123-45-67890"
        digit = lambda i: 0 <= i < len(text) and text[i].isdigit()
        assert len(self.ssn.match_all(text)) == 1
        assert self.ssn.match_all(text, can_start=lambda i: not digit(i - 1), can_end=lambda i: not digit(i)) == []

    @pytest.mark.parametrize(("pattern", "text"), [(r"[A-Z][a-z]+", "Hello there World"), (r"a.c", "abc a\nc axc"), (r"[\d.]+", "1.2.3 and 45"), ("x*y", "xxy y xy"), ("(?:ab)+", "ababab ab a"), ("colou?r", "color colour colr"), (r"\w{2,3}", "abcdefg h ij")])
    def test_exact_agrees_with_re(self, pattern, text):
        import re

        assert [text[m.start : m.end] for m in FuzzyPattern(pattern).match_all(text)] == [m[0] for m in re.finditer(pattern, text)]

    @pytest.mark.parametrize("pattern", ["(?<=a)b", "^a", r"\bword", r"(a)\1", "[abc", "a{3,1}", "*a", "(a"])
    def test_refuses(self, pattern):
        with pytest.raises(ValueError):
            FuzzyPattern(pattern)

    def test_all_ends(self):
        assert [m.end for m in FuzzyPattern(r"\d{2,4}").search("12345")] == [2, 3, 4, 5]


NEXT_TO = [
    ("on +1 (608) 555-2280 37.92.178.161 in", ["+1 (608) 555-2280", "37.92.178.161"]),
    ("XY12 3456 GB29 NWBK 6016 1331 9268 19", ["GB29 NWBK 6016 1331 9268 19"]),
]


@pytest.mark.parametrize("text,words", NEXT_TO)
def test_a_number_that_follows_another_is_found_on_its_own(text, words):
    assert [text[f.start : f.end] for f in P.find_matches(text)] == words


def test_an_entity_across_the_parts_of_a_document_is_found_whole(spark):
    from pyspark.sql import functions as F

    from pagewright.functions.boxes import text_of
    from pagewright.operators import entities as E
    from pagewright.operators.words import as_document
    from pagewright.plans.registry import NerMerger
    from pagewright.schemas import document

    rows = [(1, "in reingwh. +1 (274) 555-9629 Ateson then."), (2, "a@b.org,+1 (274) 555-9629 c@d.org"), (3, "one a@b.org c@d.org two"), (4, "")]
    whole = as_document(spark.createDataFrame(rows, "id int, text string"), "id", "text").withColumnRenamed("document", "merged")
    half = F.slice(F.col("merged.bboxes"), 1, (F.size("merged.bboxes") / 2).cast("int"))
    docs = whole.withColumn("document", document(text_of(half), half)).withColumn("delta", E.document_delta(F.col("document"), F.col("merged")))
    docs = docs.withColumn("seam", E.seam(F.col("document"), F.col("delta"), 3))
    read = P.pattern_entities(P.pattern_entities(P.pattern_entities(docs, "document", "ner"), "delta", "delta_ner"), "seam", "seam_ner")
    read = E.settle_seam(read, ["ner", "delta_ner"], "seam_ner", "document", "delta")
    made = NerMerger().run(read).select("id", F.explode("ner.entities").alias("e")).select("id", "e.word").collect()
    assert sorted(map(tuple, made)) == [(1, "+1 (274) 555-9629"), (2, "+1 (274) 555-9629"), (2, "a@b.org"), (2, "c@d.org"), (3, "a@b.org"), (3, "c@d.org")]
