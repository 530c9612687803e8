"""Ladders by hand: rungs in between, names that changed, lone levels, cups."""

from rallyframe.operators import movements as mv


def ladders(spark, **clubs):
    rows = [(club, label) for club, labels in clubs.items() for label in labels]
    out = {}
    for r in mv.ladder(spark.createDataFrame(rows, "club string, label string"), "club").orderBy("club", "rank").collect():
        out.setdefault(r["club"], []).append(r["label"])
    return out


def test_ladders(spark):
    got = ladders(
        spark, between=["D2", "PREREG"], four=["D4", "D1"], renamed=["DEP", "D1", "D2"], plain=["DEP", "PREREG"], region=["R1", "REGIONAL", "R3", "PRENAT"], old=["N1"], both=["N1", "ELITE"], top=["PRO A", "R2"],
        cup=["CDF", None], lone=["D3"], leisure=["LOISIR"], one=["R2"], nation=["NATIONAL"],
    )
    assert got == {
        "between": ["D2", "D1", "Préreg"], "four": ["D4", "D3", "D1"], "renamed": ["D2", "D1 / Dép"], "plain": ["Dép", "Préreg"], "region": ["R3", "R1 / Régionale", "Prénat"], "old": ["N3", "N2", "N1"], "both": ["N3", "N2", "Élite / N1"],
        "top": ["R2", "N3", "N2", "Élite", "Pro B", "Pro A"], "cup": ["Dép", "Régionale"], "lone": ["D3", "Régionale"], "leisure": ["Dép", "Loisir"], "one": ["Dép", "R2"], "nation": ["N3", "N2"],
    }


def test_entries_on_their_ladder(spark):
    rows = [("a", 1, "DEP"), ("a", 2, "D1"), ("a", 3, "PREREG"), ("a", 3, "CDF"), ("b", 1, "D1"), ("b", 2, "ELITE")]
    got = {tuple(r)[:3]: (r["rank"], r["step"]) for r in mv.on_ladder(spark.createDataFrame(rows, "club string, season int, label string"), "club").select("club", "season", "label", "rank", "step").collect()}
    assert got["a", 1, "DEP"] == got["a", 2, "D1"] == (0, "D1 / Dép") and got["a", 3, "PREREG"] == (1, "Préreg") and got["a", 3, "CDF"] == (None, None)
    assert got["b", 2, "ELITE"] == (3, "Élite")


def test_challenge_bracket(spark):
    schema = "season int, competition string, pool string, code string, match_id long, team_a long, team_b long, sets_a int, sets_b int, played boolean"
    semis = [("A", f"A{n}", n, 2 * n, 2 * n + 1, 3, 0) for n in range(4)]  # 0, 2, 4, 6 win
    finals = [("B", "B1", 11, 4, 6, 3, 2), ("B", "B2", 12, 7, 5, 0, 3), ("B", "B3", 13, 2, 0, 3, 1), ("B", "B4", 14, 1, 3, 3, 1)]
    rows = [(1, "full", *x, True) for x in semis + finals]
    rows += [(1, "no bronze", *x, True) for x in semis + finals[:3]]
    rows += [(1, "one pool", *x, True) for x in semis] + [(1, "one final", *x, True) for x in semis + finals[:2]]
    rows += [(1, "not played", *x, False) for x in semis] + [(1, "not played", *x, True) for x in finals]
    got = {(r["competition"], r["half"]): tuple(r)[3:] for r in mv.challenge_bracket(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("full", "lower"): (2, 3, 11, 12), ("full", "upper"): (0, 1, 13, 14), ("no bronze", "lower"): (2, 3, 11, 12), ("no bronze", "upper"): (0, 1, 13, None)}
