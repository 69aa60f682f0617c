from lumenbib.operators import retrieve
from lumenbib.plans import queries


def test_topic_queries_run_the_whole_job(spark, data, monkeypatch):
    """The search merges and takes the default limit, the trace the default total."""
    seen = {}

    def stop(name):
        def run(*args, **how):
            seen[name] = (args, how)
            raise InterruptedError

        return run

    monkeypatch.setattr(queries.plan, "search_topics", stop("search"))
    monkeypatch.setattr(retrieve, "retrieve", stop("trace"))
    for name in ("topic_search", "match_trace"):
        try:
            queries.QUERIES[name](spark, data)
        except InterruptedError:
            pass
    assert not {"merge", "limit"} & set(seen["search"][1]) and len(seen["search"][0]) == 4
    assert len(seen["trace"][0]) == 2 and not seen["trace"][1]
