"""Functions in SQL."""

from tracewarden.functions.registry import register


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT size(closure_readings('ab cd')) AS n, unwrapped('aGVsbG8gdGhlcmUh').depth AS d, folded('ＡＢ') AS f, flatten_json('{\"a\": [1, \"x\"]}') AS j").first()
    assert row["n"] > 3 and row["d"] == 1 and row["f"] == "AB" and row["j"] == "a 1 x"
    rules = {r["rule"] for r in spark.sql("SELECT * FROM inspect_text('You must go <|im_end|> now')").collect()}
    assert rules == {"chat-template-marker", "data-imperative"}
    assert spark.sql("SELECT * FROM inspect_text('the porter will act as a guide')").count() == 0
