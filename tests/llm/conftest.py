import pytest

EDGES = [
    (9001, None), (9002, ""), (9003, " \t\n "), (9004, "one"), (9005, "a b c d e"), (9005, "a b c d e"), (9006, "é" * 50), (9007, "x " * 3000),
    (9008, "Released under the MIT License. Apache License, Version 2.0; cc by nc cc-by-nc"), (9009, " a b c"), (None, "no id here"), (9010, "\n\n\nline one two\n\nline one two\n"),
    (9011, "mail a.b@c.de@f.gh x@y 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 +1 (017) 555-7713 +12 x@y..z a@b.c"), (9012, "w" * 5000 + " " + "y z " * 40), (9013, "This work is licensed under the GNU General Public License, version 3."),
]


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    """The small table, odd rows, and columns whose names the operators use inside."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(EDGES, "doc_id long, text string")
    more = "1 as row_number, 2 as block, 'x' as rules, 'y' as license, 3 as size, 4 as queue, 's' as source, 5 as n_words, array(1) as hits"
    return real.unionByName(odd).selectExpr("*", *more.split(", "))


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
