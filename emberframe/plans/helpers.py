"""Byte, text and file helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.functions import columns as c
from emberframe.plans.registry import query
from emberframe.plans.tables import read


@query("b1_zstd_roundtrip", "SELECT doc_id, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS n FROM documents")
def zstd(spark, d):
    from emberframe.functions.zstd import compress, decompress

    t = read(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    t = t.select("doc_id", "raw", decompress(compress(F.col("raw"))).alias("back"))
    return t.select("doc_id", F.sha2("back", 256).alias("digest"), F.octet_length("back").cast("long").alias("n"))


@query("b3_compress_bound", "SELECT doc_id, n_chars + (n_chars >> 8) + CASE WHEN n_chars < 131072 THEN (131072 - n_chars) >> 11 ELSE 0 END AS bound FROM documents")
def bound(spark, d):
    return read(spark, d, "documents").select("doc_id", c.compress_bound(F.col("n_chars")).alias("bound"))


@query("b6_count_substring", "SELECT doc_id, ((length(text) - length(replace(text, 'an', ''))) // 2)::INTEGER AS n FROM documents")
def count(spark, d):
    return read(spark, d, "documents").select("doc_id", c.count_substring(F.col("text"), "an").alias("n"))


@query("b7_replace", "SELECT doc_id, md5(replace(text, 'the', '<T>')) AS digest FROM documents")
def replaced(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(F.replace(F.col("text"), F.lit("the"), F.lit("<T>"))).alias("digest"))


@query("b8_split_join", "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::INTEGER AS n, md5(array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), '+')) AS digest FROM documents")
def split_join(spark, d):
    t = read(spark, d, "documents").select("doc_id", c.split_text(F.col("text"), " ").alias("p"))
    return t.select("doc_id", F.size("p").alias("n"), F.md5(F.concat_ws("+", "p")).alias("digest"))


@query("b10_find_case_insensitive", "SELECT doc_id, (strpos(lower(text), 'ent') - 1)::INTEGER AS at FROM documents")
def find(spark, d):
    return read(spark, d, "documents").select("doc_id", c.find_case_insensitive(F.col("text"), "Ent").alias("at"))


@query("b11_from_string", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS v, coalesce(try_cast(event_type AS DOUBLE), 0.0) AS bad FROM events")
def numbers(spark, d):
    t = read(spark, d, "events")
    return t.select("event_id", c.to_number(F.get_json_object("props", "$.k")).alias("v"), c.to_number(F.col("event_type")).alias("bad"))


@query("b14_format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, epoch_us(ts) // 1000 AS ms FROM events")
def times(spark, d):
    t = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return t.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"), F.unix_millis("ts").alias("ms"))


@query("b15_binary32", "SELECT o_orderkey, right(lpad(bin(o_orderkey), 32, '0'), 12) AS bits FROM orders")
def bits(spark, d):
    return read(spark, d, "orders").select("o_orderkey", c.binary32(F.col("o_orderkey"), 12).alias("bits"))


@query("b4_attribute_map", "SELECT event_id, len(json_keys(props))::INTEGER AS n, json_extract_string(props, '$.k') AS k FROM events")
def attribute_map(spark, d):
    t = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return t.select("event_id", F.size(F.map_keys("m")).alias("n"), F.try_element_at("m", F.lit("k")).alias("k"))


