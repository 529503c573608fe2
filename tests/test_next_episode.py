"""The next episode of an account comes from its own episodes met with the title's once."""

import datetime as dt

from tastegraph.demo.model import AS_OF
from tastegraph.operators import views as W

EPISODE = "id long, season_id long, title_id long, episode_number int, name string, air_date date"


def told(spark, t, seen, aired_only=False):
    # title 1: seasons 1 and 2 of three episodes each, the last one not aired
    episodes = [(s * 10 + e, s, 1, e, f"{s}.{e}", dt.date(2000 if (s, e) < (2, 3) else 2099, 1, 1)) for s in (1, 2) for e in (1, 2, 3)]
    state = t.title_state.limit(0).unionByName(
        spark.createDataFrame([(a, 1, "watching") for a in seen], "account_id long, title_id long, status string"), allowMissingColumns=True)
    tables = t.replace(
        episode=spark.createDataFrame(episodes, EPISODE), season=spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "id long, title_id long, season_number int"),
        episode_progress=spark.createDataFrame([(a, e) for a, ids in seen.items() for e in ids], "account_id long, episode_id long"), title_state=state)
    rows = W.user_title(tables, AS_OF, aired_only).select("account_id", "episodes_watched", "next_episode_id").collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def test_next_episode_is_the_first_unseen(spark, t):
    seen = {1: [], 2: [11], 3: [11, 12, 21], 4: [12, 13], 5: [11, 12, 13, 21, 22, 23], 6: [11, 12, 13, 21, 22], 7: [23], 8: [11, 11, 99], 9: [11, 23]}
    assert told(spark, t, seen) == {1: (0, 11), 2: (1, 12), 3: (3, 13), 4: (2, 11), 5: (6, None), 6: (5, 23), 7: (1, 11), 8: (1, 12), 9: (2, 12)}
    assert told(spark, t, seen, aired_only=True) == {1: (0, 11), 2: (1, 12), 3: (3, 13), 4: (2, 11), 5: (6, None), 6: (5, None), 7: (1, 11), 8: (1, 12), 9: (2, 12)}


def test_progress_is_met_once(spark, t):
    mark = spark.createDataFrame([(1, 2)], "account_id long, episode_id long").withColumnRenamed("episode_id", "marked").withColumnRenamed("marked", "episode_id")
    plan = W.user_title(t.replace(episode_progress=mark), AS_OF)._jdf.queryExecution().analyzed().toString()
    assert "LeftAnti" not in plan and plan.count("AS marked") == 1
