"""Which protocol a packet may be of: by its ports, or by the shape of its payload (looser than the decoders' own tests)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otspark.functions import codes
from otspark.functions.dims import DEFAULT_PORTS
from otspark.functions.net import byte_array, size, u8, u16, u16le
from otspark.operators.cleartext import ber, begins_with

#: Protocols with a test of the payload, in the order in which they are tried.
SHAPES = ("modbus", "s7", "dnp3", "enip", "iec104", "opcua", "bacnet", "mqtt", "snmp")


def by_port() -> Column:
    """The protocol of the destination's port, else of the source's; null for neither."""
    known = F.create_map(*[F.lit(x) for slug, ports in DEFAULT_PORTS.items() for p in ports for x in (p, slug)])
    return F.coalesce(F.try_element_at(known, "dst_port"), F.try_element_at(known, "src_port"))


def shape(slug: str) -> Column:
    """Whether the payload (bytes in _bytes) has the shape of a protocol's messages."""
    b, n = F.col("_bytes"), size(F.col("payload"))
    if slug == "modbus":
        test = (n >= 7) & (u16(b, 2) == 0) & u16(b, 4).between(1, 253)
    elif slug == "s7":
        test = (n >= 4) & (u16(b, 0) == 0x0300) & (u16(b, 2) >= 7)
    elif slug == "dnp3":
        test = (n >= 3) & (u16(b, 0) == 0x0564)
    elif slug == "enip":
        test = (n >= 24) & u16le(b, 0).isin(*codes.ENIP_COMMANDS)
    elif slug == "iec104":
        test = (n >= 2) & (u8(b, 0) == 0x68)
    elif slug == "opcua":
        test = (n >= 8) & begins_with(F.col("payload"), *codes.OPCUA_MESSAGES)
    elif slug == "bacnet":
        test = (n >= 4) & (u8(b, 0) == 0x81)
    elif slug == "mqtt":
        used = F.coalesce(*[F.when(u8(b, i) < 128, i) for i in range(1, 5)])
        left = sum((F.when(used > i, u8(b, i + 1).bitwiseAND(127) * 128**i).otherwise(0) for i in range(1, 4)), u8(b, 1).bitwiseAND(127))
        test = (n >= 2) & F.shiftright(u8(b, 0), 4).between(1, 15) & used.isNotNull() & (n >= used + 1 + left)
    else:  # snmp: a sequence that begins with a version
        at = ber(b, F.lit(1))["at"]
        test = (n >= 8) & (u8(b, 0) == 0x30) & (u8(b, at) == 2) & (u8(b, at + 1) == 1) & (u8(b, at + 2) <= 3)
    return F.coalesce(test, F.lit(False))


def guessed(packets: DataFrame, protocols: tuple[str, ...] | list[str] = SHAPES) -> DataFrame:
    """Packets with port_guess, and payload_guess: the first of the protocols whose shape the payload has."""
    told = packets.withColumn("port_guess", by_port()).withColumn("_bytes", byte_array(F.col("payload")))
    guess = F.coalesce(*[F.when(shape(s), F.lit(s)) for s in protocols if s in SHAPES], F.lit(None).cast("string"))
    return told.withColumn("payload_guess", guess).drop("_bytes")
