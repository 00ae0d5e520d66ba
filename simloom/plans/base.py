"""Registration of queries, and the SQL of the roles that tables play."""

from __future__ import annotations

EGO_TELE = "e AS (SELECT vec_id AS idx, label::BIGINT AS task, vec_id % 7 AS grp, embedding::DOUBLE[] AS v FROM embeddings), ego AS (SELECT * FROM e WHERE idx % 2 = 0), tele AS (SELECT * FROM e WHERE idx % 2 = 1)"
CROSS = f"{EGO_TELE}, x AS (SELECT ego.idx AS i, tele.idx AS j, ego.task AS ti, tele.task AS tj, round(list_dot_product(ego.v, tele.v), 9) AS s FROM ego, tele)"
FRAMES = "f AS (SELECT user_id AS episode, event_type AS task_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, value, event_id FROM events)"
STATES = "t AS (SELECT l_orderkey AS seg, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) - 1 AS fr, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, l_discount::DOUBLE AS c, l_tax::DOUBLE AS d FROM lineitem)"


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
