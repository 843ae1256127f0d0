"""Queries that write logs and statistics files and scan them: JSON lines, rotated and compacted logs, YAML."""

from datetime import datetime

from pyspark.sql import functions as F

from .. import streaming
from ..functions import safejson
from ..shared import new_folder
from ..sources import jsonl, yamlstats
from .q_retrieval import LAST
from .q_retrieval import LOG as OPERATIONS
from .registry import derived, query, table

#: Every tenth line is broken, and some are no JSON at all.
LINES = (
    "select cast(ts as date) as day, case when event_id % 10 = 0 then concat('{\"event_id\": ', cast(event_id as string), ', \"type') when event_id % 37 = 1 then 'plain words' "
    "else concat('{\"event_id\": ', cast(event_id as string), ', \"type\": \"', event_type, '\", \"timestamp\": \"', cast(ts as string), '\", \"cost\": ', cast(user_id as string), '}') end as value from events"
)
SCHEMA = "event_id long, type string, timestamp timestamp, cost long"
WHOLE = "event_id % 10 <> 0 and event_id % 37 <> 1"
SINCE = datetime(2024, 1, 12, 6)


def _lines(spark, sf):
    """The log, dealt to a folder a day."""
    where = new_folder(spark, "event-log")
    derived(spark, sf, LINES, "events").write.partitionBy("day").text(where)
    return where


@query(f"select event_type as type, count(*) as n, cast(sum(user_id) as bigint) as cost from events where {WHOLE} and ts >= timestamp '{SINCE}' group by 1")
def s15_event_scan(spark, sf):
    rows = jsonl.scan_jsonl(spark, _lines(spark, sf), SCHEMA)
    return jsonl.since(rows, SINCE, day="day").groupBy("type").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


@query(f"select event_id, user_id as cost, event_type as type from events where {WHOLE}")
def s16_cost_scan(spark, sf):
    """Broken lines go to a folder of their own; what is left loads in the mode that would end at the first of them."""
    where = new_folder(spark, "whole-log")
    whole = jsonl.quarantined(jsonl.scan_jsonl(spark, _lines(spark, sf), SCHEMA, "keep"), new_folder(spark, "broken-lines"))
    whole.drop("day").write.json(where)
    return jsonl.scan_jsonl(spark, where, SCHEMA, "fail").select("event_id", "cost", "type")


@query("select bad_line, count(*) as n from (select case when event_id % 10 = 0 then concat('{\"event_id\": ', event_id, ', \"type') else 'plain words' end as bad_line from events where event_id % 10 = 0 or event_id % 37 = 1) group by 1")
def s16_broken_lines(spark, sf):
    where = new_folder(spark, "broken-lines")
    jsonl.quarantined(jsonl.scan_jsonl(spark, _lines(spark, sf), SCHEMA, "keep"), where)
    return spark.read.text(where).groupBy(F.col("value").alias("bad_line")).agg(F.count("*").alias("n"))


@query(f"with h as (select event_id, event_type as type from events where {WHOLE} order by ts desc, event_id desc limit 100), n as (select count(*) as total from events where {WHOLE}) select event_id, type, total from h, n")
def s17_history_scan(spark, sf):
    """The last hundred records of the log, and how many it has."""
    rows = jsonl.scan_jsonl(spark, _lines(spark, sf), SCHEMA)
    total = rows.where("event_id is not null").agg(F.count("event_id").alias("total"))
    return jsonl.recent(rows, 100, F.desc("timestamp"), F.desc("event_id")).select("event_id", "type").crossJoin(F.broadcast(total))  # one row


@query("select event_type as type, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by 1")
def k11_buffered_log(spark, sf):
    """The event table as a stream, kept in a log of flushes and read back: each record once."""
    where = new_folder(spark, "buffered-log")
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("type"))
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet").select("event_id", F.col("event_type").alias("type"))
    streaming.buffered_log(stream, f"{where}/log", f"{where}/checkpoint", every=None, rows=1000, limit=1 << 40).awaitTermination()
    return streaming.read_log(spark, f"{where}/log", rows.schema.simpleString()[7:-1].replace(":", " "), "both").groupBy("type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"select cast(id as varchar) as id, entry from ({LAST})")
def k14_compacted_log(spark, sf):
    """The log is written, compacted, added to and compacted again; its entries are those of a replay of the whole log."""
    where, log = new_folder(spark, "operations"), derived(spark, sf, OPERATIONS, "events").withColumn("id", F.col("id").cast("string"))
    first = F.col("timestamp") < 25
    jsonl.append_operations(log.where(first), where)
    jsonl.compact(spark, where, -1)
    jsonl.append_operations(log.where(~first), where)
    jsonl.compact(spark, where, 100)
    return jsonl.read_operations(spark, where).select("id", "entry")


#: Dangerous keys at the top, three levels down and in arrays; every ninth text is broken.
NESTED = (
    "select event_id, case when event_id % 9 = 0 then '{\"a\": [1, }' else concat('{\"user\": ', cast(user_id as string), case when event_id % 2 = 0 then ', \"__proto__\": {\"x\": 1}' else '' end, "
    "', \"a\": {\"b\": {\"c\": \"', event_type, '\"', case when event_id % 3 = 1 then ', \"constructor\": null' else '' end, '}}, \"list\": [[{\"k\": true', case when event_id % 5 = 1 then ', \"__lookupGetter__\": []' else '' end, '}], 1.5]}') end as text from events"
)


@query("select event_id, case when event_id % 9 <> 0 then concat('{\"user\":', user_id, ',\"a\":{\"b\":{\"c\":\"', event_type, '\"}},\"list\":[[{\"k\":true}],1.5]}') end as value, case when event_id % 9 <> 0 then event_id % 2 = 0 or event_id % 3 = 1 or event_id % 5 = 1 end as dangerous from events")
def g43_nested_keys(spark, sf):
    rows = derived(spark, sf, NESTED, "events")
    return rows.select("event_id", safejson.safe_json("text").alias("value"), safejson.has_dangerous_keys("text").alias("dangerous"))


@query("select event_id, case when event_id % 2 = 0 then [concat('type=', event_type), concat('user=', user_id)] else [concat('type=', event_type)] end as config from events")
def p14_known_keys(spark, sf):
    raw = F.create_map(F.lit("type"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("colour"), F.col("user_id").cast("string"))
    kept = F.map_entries(safejson.known_keys(raw, ("type", "user")))
    return table(spark, sf, "events").select("event_id", F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("config"))


#: Statistics of customers as agents: nested maps, lists of maps, comments and quotes; every eleventh file is broken.
STATS = (
    "select c_custkey as doc_id, concat('agent', cast(c_custkey as string)) as agent, case when c_custkey % 11 = 0 then concat('total_tasks: 1', chr(10), 'no key here') else concat('# statistics', chr(10), case when c_custkey % 2 = 0 then concat('agent_name: \"', c_name, ': \\\\ # no comment\"', chr(10)) else '' end, "
    "'total_tasks: ', cast(c_custkey % 50 as string), '  # all', chr(10), 'trends:', chr(10), '  success_rate_trend: -', cast(c_nationkey as string), '.5', chr(10), 'recent_tasks:', chr(10), "
    "'- id: 1', chr(10), '  tags: [a, ''b, c'']', chr(10), case when c_custkey % 3 = 0 then concat('- id: 2', chr(10), '  note:', chr(10)) else '' end, 'specializations: {}', chr(10), 'metadata:', chr(10), '  overall_health: ~', chr(10)) end as text from customer"
)


@query("select c_custkey as doc_id, case when c_custkey % 2 = 0 then concat(c_name, ': \\ # no comment') else concat('agent', c_custkey) end as agent, cast(c_custkey % 50 as double) as total_tasks, cast(-(c_nationkey + 0.5) as double) as trend, case when c_custkey % 3 = 0 then 2 else 1 end as recent_tasks from customer where c_custkey % 11 <> 0")
def s18_agent_stats(spark, sf):
    got = yamlstats.agent_stats(derived(spark, sf, STATS, "customer"))
    return got.select("doc_id", "agent", "total_tasks", F.col("success_rate_trend").alias("trend"), F.col("recent_tasks").cast("int").alias("recent_tasks"))


@query("""with v as (select c_custkey as doc_id, unnest(list_concat(case when c_custkey % 2 = 0 then [struct_pack(path := 'agent_name', value := concat(c_name, ': \\ # no comment'))] else [] end,
    [struct_pack(path := 'total_tasks', value := cast(c_custkey % 50 as varchar)), struct_pack(path := 'trends.success_rate_trend', value := concat('-', c_nationkey, '.5')), struct_pack(path := 'recent_tasks.0.id', value := '1'), struct_pack(path := 'recent_tasks.0.tags.0', value := 'a'), struct_pack(path := 'recent_tasks.0.tags.1', value := 'b, c')],
    case when c_custkey % 3 = 0 then [struct_pack(path := 'recent_tasks.1.id', value := '2'), struct_pack(path := 'recent_tasks.1.note', value := null)] else [] end, [struct_pack(path := 'metadata.overall_health', value := null)])) as p from customer where c_custkey % 11 <> 0)
  select doc_id, p.path as path, p.value as value, false as failed from v union all select c_custkey, null, null, true from customer where c_custkey % 11 = 0""")
def s18_yaml_values(spark, sf):
    got = yamlstats.yaml_values(derived(spark, sf, STATS, "customer"))
    return got.select("doc_id", "path", "value", F.col("error").isNotNull().alias("failed"))
