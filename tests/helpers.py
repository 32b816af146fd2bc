from pyspark.sql import functions as F

from tidewarden.schemas import FLOW_SCHEMA


def records(spark, rows):
    """Flow records from short dicts; ``at`` is in seconds."""
    names = ["record_id", "at", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "history", "uid"]
    schema = "record_id long, at double, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long, history string, uid string"
    base = {"src_ip": "a", "src_port": 1, "dst_ip": "b", "dst_port": 80, "protocol": "tcp", "orig_bytes": 10, "resp_bytes": 0,
            "orig_pkts": 1, "resp_pkts": 0, "history": "S", "uid": ""}
    data = [tuple({**base, "record_id": i, **r}[n] for n in names) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long"))).drop("at")
    missing = {f.name: F.lit(None).cast(f.dataType) for f in FLOW_SCHEMA.fields if f.name not in df.columns}
    return df.withColumns(missing)


def brute_windows(times, width, cap):
    """Index of each window's first row, for (key, at, id) rows in order."""
    out, state = {}, {}
    for key, at, row_id in sorted(times):
        opened = state.get(key)
        if opened is None or at - opened[0] > width or (cap is not None and opened[2] >= cap):
            opened = [at, row_id, 0]
            state[key] = opened
        opened[2] += 1
        out[row_id] = (opened[0], opened[1])
    return out
