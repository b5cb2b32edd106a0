"""Agreement with published figures, on made rows."""

from verdikt.operators import reconcile as K


def test_a_teams_other_unmatched_entry_is_no_reason_for_this_one(spark):
    results = spark.createDataFrame([("s", "x", "t", e, "", 3.0) for e in ("e1", "e2")], "season_id string, team_key string, tournament string, entry_id string, result string, points double")
    teams = spark.createDataFrame([("s", "x")], "season_id string, team_key string")
    none = spark.createDataFrame([], "season_id string, team string, tournament string, entry_id string, ours double")
    unmatched = spark.createDataFrame([("s", "x", "t", "e1")], "season_id string, team string, tournament string, entry_id string")
    got = K.audit_top(teams, results, none, unmatched, none.select("tournament"))
    assert sorted(r.cause for r in got.collect()) == ["absent", "not matched"]
    whole = K.audit_top(teams, results, none, unmatched.drop("entry_id"), none.select("tournament"))
    assert [r.cause for r in whole.collect()] == ["not matched", "not matched"]
