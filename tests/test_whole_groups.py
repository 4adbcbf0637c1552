"""Results take whole groups: no cut of candidates or rows changes them."""

import pytest

from textloom.operators import runs, web


def test_moving_average_reaches_as_far_back_as_keep_asks(spark):
    rows = spark.createDataFrame([("a", i, 1000.0 if i == 0 else 0.0) for i in range(600)], "k string, at int, value double")
    got = runs.moving_average(rows, "k", ["at"], "value", keep=0.999).first().average
    assert got == pytest.approx(1000 * 0.999**599)
    with pytest.raises(ValueError):
        runs.moving_average(rows, "k", ["at"], "value", keep=1.0)


def test_a_word_inside_a_rare_longer_one_is_left_out(spark):
    words = [f"{a}{b}word" for a in "abcdef" for b in "ghijk"]
    titles = [("s", w) for w in words for _ in range(2)] + [("s", "market")] * 5 + [("s", "supermarket"), (None, "market"), ("s", None)]
    got = {(r.site, r.topic) for r in web.related_topics(spark.createDataFrame(titles, "site string, title string"), k=50).collect()}
    assert ("s", "market") not in got and ("s", "supermarket") in got and (None, "market") in got
    assert len(got) == len(words) + 2
    assert web.related_topics(spark.createDataFrame([], "site string, title string")).count() == 0


def test_checkpoint_folder_is_needed_on_a_cluster():
    from textloom.session import checkpointed

    class Unset:
        def isEmpty(self):
            return True

        getCheckpointDir = sc = lambda self: self

    class Conf:
        def get(self, *_):
            return None

    class Context:
        _jsc, master = Unset(), "spark://host:7077"
        getConf = lambda self: Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        checkpointed(Session(), None)
