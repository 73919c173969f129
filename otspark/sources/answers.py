"""The answers view: what devices send back, connection frames and the rarer requests, by packet number; and its SQL.

The wire view (sources.packets) has the plain requests of ten protocols; this one has exceptions, responses, errors, unnumbered
frames and the Modbus requests with bodies of their own. Payloads are bytes here; the SQL has the numbers that they were made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otspark.sources.packets import PACKETS, packets

_N16, _UNIT = "cast(n % 65536 as int)", "cast(n % 247 as int)"
_LE = "cast({0} % 256 as int), cast({0} div 256 % 256 as int)"
_SESSION = _LE.format("(n % 65536)")

# fixed values of the view: name, slug, port, whether it is sent to the port, transport, codes in turn, hex of the payload (a format and its arguments; n numbers the packet, c is the code)
ANSWERS = [
    ("modbus_exception", "modbus", 502, False, "TCP", (1, 3, 5, 16), "%04X00000003%02X%02X%02X", f"{_N16}, {_UNIT}, 128 + c, cast(n % 4 + 1 as int)"),
    ("modbus_registers", "modbus", 502, False, "TCP", (3, 4), "%04X00000007%02X%02X04%04X00FF", f"{_N16}, {_UNIT}, c, {_N16}"),
    ("modbus_write_many", "modbus", 502, True, "TCP", (16,), "%04X0000000B%02X%02X%04X000204%04X00FF", f"{_N16}, {_UNIT}, c, cast(n % 1000 as int), {_N16}"),
    ("modbus_coil", "modbus", 502, True, "TCP", (5,), "%04X00000006%02X%02X%04X%02X00", f"{_N16}, {_UNIT}, c, cast(n % 1000 as int), cast(if(n % 3 = 0, 255, 0) as int)"),
    ("modbus_register", "modbus", 502, True, "TCP", (6,), "%04X00000006%02X%02X%04X%04X", f"{_N16}, {_UNIT}, c, cast(n % 1000 as int), {_N16}"),
    ("modbus_read_write", "modbus", 502, True, "TCP", (23,), "%04X0000000D%02X%02X%04X0003%04X000102%04X", f"{_N16}, {_UNIT}, c, cast(n % 1000 as int), cast(n % 900 as int), {_N16}"),
    ("modbus_identity", "modbus", 502, True, "TCP", (43,), "%04X00000005%02X%02X0E01%02X", f"{_N16}, {_UNIT}, c, cast(n % 7 as int)"),
    ("modbus_diagnostics", "modbus", 502, True, "TCP", (8,), "%04X00000006%02X%02X%04X%04X", f"{_N16}, {_UNIT}, c, cast(n % 5 as int), {_N16}"),
    ("s7_answer", "s7", 102, False, "TCP", (4, 5, 240), "0300001502F08032030000%04X00020000%02X%02X%02X02", f"{_N16}, cast(if(n % 2 = 0, 0, 129 + n % 5) as int), cast(n % 8 as int), c"),
    ("dnp3_answer", "dnp3", 20000, False, "TCP", (129, 130), "05640D44%02X%02X0A00FFFFC0D1%02X%02X%02X1E0200", _LE.format("(n % 1000)") + ", c, cast(n % 256 as int), cast(n % 64 as int)"),
    ("opcua_error", "opcua", 4840, False, "TCP", (0,), "4552524610000000%02X%02X000000000000", _SESSION),
    ("opcua_hello", "opcua", 4840, True, "TCP", (0,), "48454C4620000000%02X%02X00000000010000000200" + "00" * 10, _SESSION),
    ("enip_session", "enip", 44818, True, "TCP", (0,), "65000400%02X%02X0000" + "00" * 12 + "0500000001000000", _SESSION),
    ("enip_answer", "enip", 44818, False, "TCP", (76, 77, 14), "6F001600%02X%02X0000%02X000000" + "00" * 12 + "000000000A00020000000000B2000600%02X00%02X004142", _SESSION + ", cast(n % 2 as int), 128 + c, cast(n % 15 as int)"),
    ("iec104_s", "iec104", 2404, False, "TCP", (0,), "68040100%02X%02X", _LE.format("(2 * (n % 1000))")),
    ("iec104_u", "iec104", 2404, True, "TCP", (0,), "6804%02X000000", "cast(3 + shiftleft(4, cast(n % 6 as int)) as int)"),
    ("bacnet_ack", "bacnet", 47808, False, "UDP", (12, 14), "810A000B0130%02X00%02X0000", "cast(n % 256 as int), c"),
    ("mqtt_other", "mqtt", 1883, False, "TCP", (2, 4, 9, 13), "%02X020000", "16 * c"),
    ("snmp_answer", "snmp", 161, False, "UDP", (2,), "300E02010004047075623%dA%d03020100", "cast(n % 10 as int), c"),
    ("fins_answer", "omron_fins", 9600, False, "UDP", (257, 258), "C00002" + "00" * 11 + "%04X0000", "c"),
]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select("file_idx", "packet_number", "ts_us", "ts", "length", "src_ip", "dst_ip", F.col("src_port").alias("own"), F.col("packet_number").alias("n"), (F.col("packet_number") % len(ANSWERS)).cast("int").alias("k"))
    of = lambda i: F.element_at(F.array(*[F.lit(a[i]) for a in ANSWERS]), F.col("k") + 1)
    mine = F.element_at(F.array(*[F.array(*map(F.lit, a[5])) for a in ANSWERS]), F.col("k") + 1)
    p = p.withColumn("c", F.element_at(mine, (F.expr(f"n div {len(ANSWERS)}") % F.size(mine) + 1).cast("int")))
    body = F.expr("case k " + " ".join(f"when {k} then format_string('{a[6]}', {a[7]})" for k, a in enumerate(ANSWERS)) + " end")
    asks = of(3)
    return p.select(
        "file_idx", "packet_number", "ts_us", "ts", "length", "src_ip", "dst_ip", F.when(asks, F.col("own")).otherwise(of(2)).alias("src_port"), F.when(asks, of(2)).otherwise(F.col("own")).alias("dst_port"),
        of(4).alias("transport"), F.unhex(body).alias("payload"), "k",
    )


#: The answers view in DuckDB, to stand behind WITH: names of kinds, numbers and codes stand for the payloads.
ANSWERS_SQL = (
    f"{PACKETS}, kinds(k, kind, slug, asks, list) AS (VALUES {', '.join(f'({k}, {a[0]!r}, {a[1]!r}, {str(a[3]).lower()}, {list(a[5])})' for k, a in enumerate(ANSWERS))}), "
    f"answers AS (SELECT packet_number, packet_number AS n, kind, slug, asks, src_ip, dst_ip, list[(packet_number // {len(ANSWERS)}) % len(list) + 1] AS c FROM packets JOIN kinds ON packet_number % {len(ANSWERS)} = k)"
)
