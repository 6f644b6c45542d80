"""The text of a query's physical plan."""


def shown_plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()
