import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text) pairs; columns that operators must ignore come too."""

    def make(rows):
        full = [(k, t, "en", "s", None if t is None else len(t), "x", 1) for k, t in rows]
        return spark.createDataFrame(full, DOCS + ", key string, bytes int")

    return make


@pytest.fixture
def sql(tmp_path):
    """Runs DuckDB SQL over frames given by name; tuples by sorted column."""

    def run(query, **frames):
        con = duckdb.connect()
        for name, df in frames.items():
            df.write.parquet(str(tmp_path / name))
            con.sql(f"create view {name} as select * from '{tmp_path / name}/*.parquet'")
        found = con.sql(query)
        order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
        return [tuple(r[i] for i in order) for r in found.fetchall()]

    return run


@pytest.fixture
def same():
    """Whether a frame has the rows of a list of tuples by sorted column, in any order."""

    def check(df, expected):
        key = lambda r: tuple((x is not None, x) for x in r)
        return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=key) == sorted(expected, key=key)

    return check
