"""DuckDB SQL text of the table bindings, used to state each registered query as plain SQL.

These are the SQL twins of :mod:`newsprism.sources.bindings`; the driver runs them against
the same parquet files to check the Spark results.
"""

from __future__ import annotations

EVENT_EXPOSURES = """
select concat('e', cast(event_id as varchar)) as impression_id,
       concat('U', cast(user_id as varchar)) as user_id,
       concat('N', cast(cast(json_extract_string(props, '$.k') as integer) as varchar)) as news_id,
       ts as "timestamp",
       case when event_type = 'click' then 1 else 0 end as clicked,
       case when event_type = 'click' then value else 0.0 end as dwell_time
from events
"""

EVENT_NEWS = """
select concat('N', cast(doc_id as varchar)) as news_id, source as category, lang as topic,
       split_part(text, chr(10), 1) as headline, text as news_body
from documents
"""

EVENT_QUERY_LOG = """
select event_id as id,
       concat('q', cast(cast(json_extract_string(props, '$.k') as integer) % 7 as varchar)) as query_type,
       value / 1000.0 as execution_time,
       user_id as result_count,
       ts as "timestamp",
       event_type <> 'error' as success,
       case when event_type = 'error'
            then concat('err', cast(cast(json_extract_string(props, '$.k') as integer) % 3 as varchar))
       end as error_message
from events
"""

ORDER_LINES = """
select concat('imp_', cast(l_orderkey as varchar)) as impression_id,
       concat('U', cast(o_custkey as varchar)) as user_id,
       concat('N', cast(l_partkey as varchar)) as news_id,
       o_orderdate as "timestamp",
       case when l_returnflag = 'R' then 1 else 0 end as clicked,
       case when l_returnflag = 'R' then l_quantity else 0.0 end as dwell_time,
       l_shipdate, l_linenumber, l_quantity, l_extendedprice
from lineitem join orders on l_orderkey = o_orderkey
"""

ORDER_EXPOSURES = """
select concat('imp_', cast(l_orderkey as varchar)) as impression_id,
       concat('U', cast(o_custkey as varchar)) as user_id,
       concat('N', cast(l_partkey as varchar)) as news_id,
       o_orderdate as "timestamp",
       max(case when l_returnflag = 'R' then 1 else 0 end) as clicked,
       max(case when l_returnflag = 'R' then l_quantity else 0.0 end) as dwell_time
from lineitem join orders on l_orderkey = o_orderkey
group by l_orderkey, o_custkey, l_partkey, o_orderdate
"""

ORDER_NEWS = """
select concat('N', cast(p_partkey as varchar)) as news_id, p_brand as category, p_type as topic,
       p_name as headline, concat_ws(' ', p_name, p_brand, p_type) as news_body
from part
"""

BINDINGS = {
    "event": {"e": EVENT_EXPOSURES, "n": EVENT_NEWS, "q": EVENT_QUERY_LOG},
    "order": {"e": ORDER_EXPOSURES, "n": ORDER_NEWS, "lines": ORDER_LINES},
}


def with_tables(binding: str, body: str, *, names: tuple[str, ...] = ("e", "n")) -> str:
    """Prefix ``body`` with CTEs ``e``/``n``/``q``/``lines`` of the chosen binding."""
    ctes = ",\n".join(f"{name} as ({BINDINGS[binding][name]})" for name in names)
    stripped = body.lstrip()
    if stripped[:5].lower() == "with ":
        return f"with {ctes},\n{stripped[5:]}"
    return f"with {ctes}\n{body}"
