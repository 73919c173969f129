"""Packets from tables: the packet and polling views of the events table, and their SQL.

Packets have file_idx, packet_number (together the order of processing), ts_us, ts, length, src_ip, dst_ip, src_port,
dst_port, transport, payload; frames of decoders add function codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds of 2024-01-01.
BASE = 1_704_067_200_000_000
ORDER = ["file_idx", "packet_number"]
FLOW = ["src_ip", "dst_ip", "src_port", "dst_port", "transport"]

# fixed values of the views: what stands for each event type
DESTINATION = {"click": "192.168.1.10", "view": "192.168.1.11", "purchase": "192.168.2.20", "error": "192.168.2.21", "signup": "8.8.8.8"}
PORT = {"click": 502, "view": 102, "purchase": 20000, "error": 44818, "signup": 3389}
CODES = (1, 2, 3, 4, 5, 6, 15, 16)
RARE = (1500, 3100)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(c: Column, of: dict) -> Column:
    out = None
    for k, v in of.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet view: users are sources, event types are services, time runs a thousand times faster."""
    e = table(spark, sf_dir, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    fc = F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 8 + 1).cast("int"))
    fc = F.when(F.col("event_id").isin(*RARE), 43).otherwise(fc)
    unit = F.when(F.col("event_id") % 97 == 0, 255).otherwise(F.col("user_id") % 247).cast("int")
    body = F.format_string("%04X00000006%02X%02X%04X%04X", (F.col("event_id") % 65536).cast("int"), unit, fc, (F.col("user_id") % 1000).cast("int"), (F.col("event_id") % 125 + 1).cast("int"))
    out = e.select(
        F.lit(0).alias("file_idx"),
        F.col("event_id").alias("packet_number"),
        (F.lit(BASE) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {BASE}L) div 1000")).alias("ts_us"),
        (60 + F.floor("value")).cast("long").alias("length"),
        F.concat(F.lit("10.20."), F.expr("cast(user_id div 256 as string)"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        _case(F.col("event_type"), DESTINATION).alias("dst_ip"),
        (40000 + F.col("user_id") % 1000).cast("int").alias("src_port"),
        _case(F.col("event_type"), PORT).alias("dst_port"),
        F.lit("TCP").alias("transport"),
        F.unhex(body).alias("payload"),
        fc.cast("int").alias("fc"),
        unit.alias("unit"),
    )
    del ts
    return out.withColumn("ts", F.timestamp_micros("ts_us"))


def case_sql(column: str, of: dict) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v!r}" for k, v in of.items()) + " END"


#: The packet view in DuckDB, to stand behind WITH.
PACKETS = f"""packets AS (
  SELECT 0 AS file_idx, event_id AS packet_number, {BASE} + (epoch_us(ts) - {BASE}) // 1000 AS ts_us,
    CAST(60 + floor(value) AS BIGINT) AS length,
    '10.20.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
    {case_sql("event_type", DESTINATION)} AS dst_ip,
    CAST(40000 + user_id % 1000 AS INTEGER) AS src_port,
    CAST({case_sql("event_type", PORT)} AS INTEGER) AS dst_port, 'TCP' AS transport,
    CAST(CASE WHEN event_id IN {RARE} THEN 43 ELSE ({list(CODES)})[event_id % 8 + 1] END AS INTEGER) AS fc,
    CAST(CASE WHEN event_id % 97 = 0 THEN 255 ELSE user_id % 247 END AS INTEGER) AS unit,
    event_id % 65536 AS txn, CAST(user_id % 1000 AS INTEGER) AS addr, CAST(event_id % 125 + 1 AS INTEGER) AS qty
  FROM events)"""


def polling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polling view: 40 slots that are polled every ten seconds, with jitter, gaps and a burst and a lull of traffic."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    slot = i % 40
    jitter = (i * 7919) % 5000
    gap = F.when(slot < 8, F.expr("event_id div 400") * 900_000_000).otherwise(0)
    second = F.when(i % 2400 < 60, F.expr("event_id div 2400") * 200).when((i % 2400).between(1200, 1210), F.expr("event_id div 12") + 1).otherwise(F.expr("event_id div 12"))
    return e.select(
        F.lit(0).alias("file_idx"),
        i.alias("packet_number"),
        (F.lit(BASE) + i * 250_000 + jitter + gap).alias("ts_us"),
        F.when(slot.isin(10, 11) & (i % 11 == 0), 1460).otherwise(64 + i % 7).cast("long").alias("length"),
        F.concat(F.lit("10.1.0."), slot.cast("string")).alias("src_ip"),
        F.lit("10.2.0.1").alias("dst_ip"),
        (50000 + slot).cast("int").alias("src_port"),
        F.lit(502).alias("dst_port"),
        F.lit("TCP").alias("transport"),
        second.alias("sec"),
    ).withColumn("ts", F.timestamp_micros("ts_us"))


POLLING = f"""packets AS (
  SELECT 0 AS file_idx, event_id AS packet_number,
    {BASE} + event_id * 250000 + (event_id * 7919) % 5000 + CASE WHEN event_id % 40 < 8 THEN (event_id // 400) * 900000000 ELSE 0 END AS ts_us,
    CAST(CASE WHEN event_id % 40 IN (10, 11) AND event_id % 11 = 0 THEN 1460 ELSE 64 + event_id % 7 END AS BIGINT) AS length,
    '10.1.0.' || (event_id % 40) AS src_ip, '10.2.0.1' AS dst_ip, CAST(50000 + event_id % 40 AS INTEGER) AS src_port, CAST(502 AS INTEGER) AS dst_port, 'TCP' AS transport,
    CASE WHEN event_id % 2400 < 60 THEN (event_id // 2400) * 200 WHEN event_id % 2400 BETWEEN 1200 AND 1210 THEN event_id // 12 + 1 ELSE event_id // 12 END AS sec
  FROM events)"""


# fixed values of the talk view: source port (None: the user's), destination port (None: the user's), transport and payload of each kind
_SNMP = "302902010104067075626c6963a01c020458000000020100020100300e300c06082b060102010101000500"
TALK = [
    (None, 502, "TCP", None),  # the Modbus request of the packet view
    (None, 502, "TCP", b"plain text here".hex()),
    (None, 2404, "TCP", "680443000000"),
    (None, 443, "TCP", "160301002000"),
    (None, 80, "TCP", None),  # a web request to a host of the user
    (21, None, "TCP", b"220 plant FTP server ready".hex()),
    (None, 22, "TCP", b"SSH-2.0-OpenSSH".hex()),
    (None, 23, "TCP", b"login: ".hex()),
    (None, 53, "UDP", None),  # a question for a name of the user
    (None, 161, "UDP", _SNMP),
    (None, 8080, "TCP", b"POST /login HTTP/1.1\r\nAuthorization: Basic YWJj\r\n\r\n".hex()),
    (None, 9600, "TCP", (b"abcdefghij" * 4).hex()),
]
FLAGS = (2, 24, 17, 4)


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The talk view: packets of the packet view that carry twelve kinds of payload in turn; every fiftieth is an ARP frame."""
    p = packets(spark, sf_dir)
    kind, user = (F.col("packet_number") % len(TALK)).cast("int"), F.col("src_port") - 40000
    ip = F.col("packet_number") % 50 != 0
    of = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in TALK]), kind + 1)
    web = F.concat(F.lit("GET /plc/status HTTP/1.1\r\nHost: h"), (user % 7).cast("string"), F.lit(".plant.example\r\nUser-Agent: Nmap\r\n\r\n")).cast("binary")
    ask = F.unhex(F.concat(F.lit("000101000001000000000000026e3"), (user % 9).cast("string"), F.lit("076578616d706c65036f72670000010001")))
    body = F.when(kind == 0, F.col("payload")).when(kind == 4, web).when(kind == 8, ask).otherwise(F.unhex(of(3)))
    return p.select(
        "file_idx", "packet_number", "ts_us", "ts", "length", "fc",
        F.concat(F.lit("00:0e:8c:00:00:"), F.lower(F.lpad(F.hex(user % 256), 2, "0"))).alias("src_mac"), F.lit("00:1b:1b:00:00:01").alias("dst_mac"), F.when(ip, 0x0800).otherwise(0x0806).alias("eth_type"),
        F.when(ip, F.col("src_ip")).alias("src_ip"), F.when(ip, F.col("dst_ip")).alias("dst_ip"),
        F.when(ip, F.when(of(2) == "TCP", 6).otherwise(17)).alias("ip_proto"), F.when(ip, of(2)).alias("transport"),
        F.when(ip, F.coalesce(of(0), F.col("src_port"))).alias("src_port"), F.when(ip, F.coalesce(of(1), F.col("src_port"))).alias("dst_port"),
        F.when(ip & (of(2) == "TCP"), F.element_at(F.array(*map(F.lit, FLAGS)), (F.col("packet_number") % 4 + 1).cast("int"))).alias("tcp_flags"), F.when(ip, body).alias("payload"),
    )


def _talk_list(i: int) -> str:
    return "[" + ", ".join("NULL" if t[i] is None else repr(t[i]) for t in TALK) + "]"


#: The talk view in DuckDB: kinds and users stand for the payloads. To stand behind WITH.
TALK_SQL = f"""{PACKETS},
 talk AS (SELECT file_idx, packet_number, ts_us, length, fc, packet_number % 12 AS k, src_port - 40000 AS u,
    '00:0e:8c:00:00:' || printf('%02x', (src_port - 40000) % 256) AS src_mac, CASE WHEN packet_number % 50 = 0 THEN 2054 ELSE 2048 END AS eth_type,
    src_ip, dst_ip, ({_talk_list(2)})[packet_number % 12 + 1] AS transport,
    coalesce(({_talk_list(0)})[packet_number % 12 + 1], src_port) AS src_port, coalesce(({_talk_list(1)})[packet_number % 12 + 1], src_port) AS dst_port,
    ({list(FLAGS)})[packet_number % 4 + 1] AS tcp_flags FROM packets),
 ip AS (SELECT * FROM talk WHERE packet_number % 50 <> 0)"""


# fixed values of the wire view: slug, port, transport, codes in turn, hex of the payload (a format and its arguments; n numbers the packet, c is the code)
_LOW = "cast({0} % 256 as int), cast({0} div 256 % 256 as int)"
WIRE = [
    ("s7", 102, "TCP", (4, 5, 26, 40, 41, 240), "0300001902f08032010000%04X00080000%02X01000000000000", "cast(n % 65536 as int), c"),
    ("dnp3", 20000, "TCP", (1, 2, 3, 5, 13, 23), "05640bc4%02X%02X0300ffffc0c1%02X3c020600", _LOW.format("(n % 1000)") + ", c"),
    ("opcua", 4840, "TCP", (631, 673, 527, 712, 461), "4d53474620000000%02X%02X0000010000000100%02X%02X" + "00" * 16, _LOW.format("(n % 65536)") + ", " + _LOW.format("c")),
    ("enip", 44818, "TCP", (76, 77, 14, 16, 5), "6f001600%02X%02X0000" + "00" * 16 + "000000000a00020000000000b2000600%02X0291034142", _LOW.format("(n % 65536)") + ", c"),
    ("iec104", 2404, "TCP", (45, 100, 105, 1), "680e%02X%02X0400%02X01060001000a000001", _LOW.format("(2 * (n % 1000))") + ", c"),
    ("bacnet", 47808, "UDP", (12, 15, 17, 3), "810a000a00000244%02X%02X", "cast(n % 256 as int), c"),
    ("mqtt", 1883, "TCP", (3,), "30070003742f3%d6869", "cast(n % 10 as int)"),
    ("snmp", 161, "UDP", (0, 1, 3, 5), "300e02010104047075623%da%d03020100", "cast(n % 10 as int), c"),
    ("omron_fins", 9600, "UDP", (257, 258, 545), "80000000000000000000%04X00", "c"),
    ("ge_srtp", 18245, "TCP", (4, 5, 1, 7), "%04X0000%02X000010" + "00" * 8, "cast(n % 65536 as int), c"),
]


def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire view: requests of the ten protocols besides Modbus in turn, by packet number."""
    p = packets(spark, sf_dir).select("file_idx", "packet_number", "ts_us", "ts", "length", "src_ip", "dst_ip", "src_port", F.col("packet_number").alias("n"), (F.col("packet_number") % len(WIRE)).cast("int").alias("k"))
    of = lambda i: F.element_at(F.array(*[F.lit(w[i]) for w in WIRE]), F.col("k") + 1)
    codes = F.array(*[F.array(*map(F.lit, w[3])) for w in WIRE])
    mine = F.element_at(codes, F.col("k") + 1)
    p = p.withColumn("c", F.element_at(mine, (F.expr("n div 10") % F.size(mine) + 1).cast("int")))
    body = F.expr("case k " + " ".join(f"when {k} then format_string('{w[4]}', {w[5]})" for k, w in enumerate(WIRE)) + " end")
    return p.select("file_idx", "packet_number", "ts_us", "ts", "length", "src_ip", "dst_ip", "src_port", of(1).alias("dst_port"), of(2).alias("transport"), F.unhex(body).alias("payload"), "k")


#: The wire view in DuckDB: numbers and codes stand for the payloads.
WIRE_SQL = f"{PACKETS}, codes(k, slug, list) AS (VALUES {', '.join(f'({k}, {w[0]!r}, {list(w[3])})' for k, w in enumerate(WIRE))}), wire AS (SELECT packet_number, packet_number AS n, slug, list[(packet_number // 10) % len(list) + 1] AS c FROM packets JOIN codes ON packet_number % 10 = k)"
