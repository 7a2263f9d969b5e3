import duckdb
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor

from custvalue.functions.materialise import materialise
from custvalue.operators import scoring, series, training
from custvalue.operators.features import rfm
from custvalue.operators.trees import TreeModel, compile_trees
from tests.conftest import rows_of


def history(make_tx):
    rows = [
        (c, f"2022-0{m}-{1 + c % 27:02d}", "w", "AB"[c % 2], 10 + c)
        for c in range(40) for m in range(1, 1 + c % 5)
    ]
    return make_tx(*rows, (99, "2022-01-05", "w", "A", 3), (99, "2022-02-01", "w", "A", 4),
                   (99, "2022-02-02", "w", "A", 6), (99, "2022-06-05", "w", "A", 100))


def test_target_is_spend_after_the_cutoff(make_tx):
    rows = training.clv_training_set(history(make_tx), "2022-01-31")
    assert rows_of(rows.filter("ctc_id = 99"), "no_visit", "value", "target") == [(1, 3.0, 10.0)]
    assert rows.filter("target is null").count() == 0


def test_fitted_model_scores_and_survives_a_save(spark, make_tx, tmp_path):
    tx = history(make_tx)
    model = training.fit_clv_model(training.clv_training_set(tx, "2022-02-28"))
    training.save_model(spark, model, str(tmp_path / "m"))
    loaded = training.load_model(spark, str(tmp_path / "m"))
    features = rfm(tx)
    scored = scoring.score_clv(features, model)
    assert scored.columns == [*features.columns, "clv_3m", "total_transaction", "frequency"]
    assert rows_of(scored) == rows_of(scoring.score_clv(features, loaded))
    assert scored.filter("clv_3m is null").count() == 0


def test_other_estimators_and_the_forecast(spark, make_tx):
    tx = history(make_tx)
    daily = series.daily_revenue(tx, "2022-01-01", "2022-12-31")
    for estimator in (None, DecisionTreeRegressor(maxDepth=2)):
        model = training.fit_forecast_model(daily, estimator)
        predicted = series.forecast(spark, "2022-07-01", "2022-07-31", model)
        assert predicted.columns == ["month", "year", "day_of_week", "day_of_year", "label"]
        assert predicted.filter("label is not null").count() == 31


def test_linear_model(spark):
    df = spark.createDataFrame([(2, 0.33335)], "a int, b double")
    model = scoring.LinearModel(1, {"a": 10, "b": -1})
    assert scoring.score(df, model, "y").first()["y"] == 20.6666


def test_a_linear_formula_survives_a_save(spark, tmp_path):
    path = str(tmp_path / "m")
    for model in (scoring.LinearModel(1.5, {"b": 2, "a": -0.25}), scoring.LinearModel(3)):
        training.save_model(spark, model, path)
        loaded = training.load_model(spark, path)
        assert loaded == model and list(loaded.coefficients) == list(model.coefficients)


def test_default_features_are_independent(spark, make_tx):
    rows = training.clv_training_set(history(make_tx), "2022-02-28")
    assembler = training.fit_clv_model(rows).stages[2]
    assert not {"customer_age", "recency", "days_since_last_visit"} <= set(assembler.getInputCols())
    tree = training.fit_clv_model(rows, DecisionTreeRegressor(maxDepth=2))
    assert set(training.CLV_FEATURES) <= set(tree.stages[2].getInputCols())


@pytest.fixture
def places(spark, make_tx):
    """Training rows in which the location decides, with names that need quoting."""
    names = ["it's", 'a "b"', "c\\d", "é", "plain"]
    rows = [
        (c, f"2022-0{m}-{1 + c % 27:02d}", "w", names[c % 5], 10 + c * (1 + c % 5))
        for c in range(90) for m in range(1, 2 + c % 5)
    ]
    tx = make_tx(*rows)
    return tx, materialise(training.clv_training_set(tx, "2022-03-01"))


ENSEMBLES = {
    "tree": lambda: DecisionTreeRegressor(maxDepth=4),
    "boosted": lambda: GBTRegressor(maxIter=6, maxDepth=3, seed=1),
    "forest": lambda: RandomForestRegressor(numTrees=5, maxDepth=4, seed=1),
}


@pytest.mark.parametrize("kind", ENSEMBLES)
def test_compiled_trees_score_like_the_pipeline(spark, places, tmp_path, kind):
    """Also unseen locations, and the same in SQL."""
    tx, rows = places
    fitted = training.fit_clv_model(rows, ENSEMBLES[kind]())
    trees = compile_trees(fitted)
    assert "location" in trees.columns() and TreeModel.from_json(trees.to_json()) == trees
    features = materialise(
        rfm(tx).unionByName(rfm(tx).limit(4).selectExpr("ctc_id", "'unseen' AS location", "no_visit", "value",
                                                       "customer_age", "recency", "days_since_last_visit"))
    )
    training.save_model(spark, trees, str(tmp_path / "m"))
    loaded = training.load_model(spark, str(tmp_path / "m"))
    assert loaded == trees
    compiled = scoring.score(features, loaded, "y")
    assert rows_of(compiled) == rows_of(scoring.score(features, fitted, "y"))
    plan = compiled._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan and "vector" not in plan.lower()
    features = features.toPandas()  # noqa: F841  read by DuckDB under this name
    in_sql = duckdb.sql(f"SELECT ctc_id, location, round_even(({trees.sql()}) * 10000, 0) / 10000 AS y FROM features")
    assert sorted(in_sql.fetchall(), key=repr) == rows_of(compiled, "ctc_id", "location", "y")


def test_a_missing_location_goes_with_the_others(spark):
    tree = {"column": "location", "one_of": ["A"], "then": {"value": 1.0}, "otherwise": {"value": 2.0}}
    df = spark.createDataFrame([("A",), ("B",), (None,)], "location string")
    model = TreeModel((tree, tree), (1.0, 0.5), 3.0)
    assert [r.y for r in scoring.score(df, model, "y").collect()] == [0.5, 1.0, 1.0]


def test_what_cannot_be_compiled(spark, places):
    _, rows = places
    with pytest.raises(TypeError, match="no trees"):
        compile_trees(training.fit_clv_model(rows, LinearRegression(regParam=0.1)))
    numbered = Pipeline(stages=[
        StringIndexer(inputCol="location", outputCol="place"),
        VectorAssembler(inputCols=["place"], outputCol="_features"),
        DecisionTreeRegressor(featuresCol="_features", labelCol="target", maxDepth=2),
    ])
    with pytest.raises(ValueError, match="category numbers"):
        compile_trees(numbered.fit(rows))


def test_the_forecast_as_trees(spark, make_tx):
    daily = series.daily_revenue(history(make_tx), "2022-01-01", "2022-12-31")
    fitted = training.fit_forecast_model(daily, GBTRegressor(maxIter=3, seed=2))
    span = (spark, "2022-01-01", "2022-06-30")
    assert rows_of(series.forecast(*span, compile_trees(fitted))) == rows_of(series.forecast(*span, fitted))
