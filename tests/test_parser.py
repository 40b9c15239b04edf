import pytest

from quillstone.errors import SyntaxFailure
from quillstone.plans import ast
from quillstone.plans.parser import parse


def value(text):
    return parse(f"SELECT a FROM t WHERE a = {text};").where[0].right.value


@pytest.mark.parametrize(
    "text, want",
    [("1+2*3", 7), ("(1+2)*3", 9), ("7/2", 3), ("-7/2", -3), ("7/-2", -3), ("-2147483648", -(2**31)), ("1 - -1", 2)],
)
def test_whole_arithmetic(text, want):
    assert value(text) == want


def test_mixed_arithmetic_is_32_bit():
    assert value("16777216 + 1.0") == 16777216.0
    assert abs(value("1/4.0") - 0.25) < 1e-9


@pytest.mark.parametrize("text", ["2147483648", "2147483647 + 1", "1/0", "1.0/0", "'a'+1", "TRUE+1"])
def test_bad_constants(text):
    with pytest.raises(SyntaxFailure):
        value(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t", "SELECT FROM t;", "SELECT a b FROM t;", "SELECT COUNT(DISTINCT *) FROM t;", "SELECT SUM(DISTINCT a) FROM t;", "SELECT a FROM t WHERE 1 = a;",
        "SELECT a FROM t WHERE a = 1 OR a = 2;", "SELECT a FROM t HAVING a IS NULL;", "SELECT a FROM t LIMIT -1;", "SELECT a FROM t OFFSET 3;", "SELECT a FROM t LIMIT 1.5;",
        "INSERT INTO t VALUES ();", "INSERT INTO t VALUES (1), (2);", "UPDATE t SET a = 1 + 2 WHERE;", "CREATE TABLE t ();", "CREATE TABLE t (a BIGINT);", "LOAD x.csv INTO t;",
        "SELECT * FROM (SELECT a FROM t) AS u;", "SELECT * FROM (SELECT a FROM t UNION SELECT a FROM t);", "SELECT select FROM t;", "SET TRANSACTION ISOLATION LEVEL READ;", "SELECT a FROM t; SELECT a FROM t;", "SELECT $0 FROM t;",
    ],
)
def test_no_statements(text):
    with pytest.raises(SyntaxFailure):
        parse(text)


def test_words_in_any_case_and_comments():
    q = parse("select /* all */ Count(*) As n -- here\n from t Group By a;")
    assert q.items[0] == ast.Item(ast.Aggregate("COUNT"), "n") and q.group == (ast.Column("a"),)


def test_forms():
    assert parse("CREATE INDEX i ON t (a, b);") == ast.CreateIndex("t", ("a", "b")) == parse("CREATE INDEX t (a,b);")
    assert parse("HELP") == parse("help;") == ast.Simple("help")
    assert parse("SET OUTPUT_FILE ON") == ast.OutputFile(True)
    assert parse("ABORT;") == parse("ROLLBACK;")
    assert parse("LOAD ../a/b-c.csv INTO t;") == ast.Load("../a/b-c.csv", "t")
    assert parse("UPDATE t SET a += 2;").sets[0] == ast.SetClause("a", ast.Column("a"), (("+", ast.Literal("int", 2, "2")),))
    assert parse("SELECT a FROM t, u AS v JOIN w ON a != b;").where[0].op == "<>"
    assert parse("SELECT * FROM (SELECT a FROM t UNION SELECT b FROM u) AS x ORDER BY a;").alias == "x"
