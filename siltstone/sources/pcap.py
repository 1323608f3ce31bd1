"""Packet captures as rows, without an external dissector.

Reads classic capture files (microsecond or nanosecond, either byte order; Ethernet, raw IP or Linux cooked frames) and gives
Time, Source, Destination, Protocol and Length of each IPv4 or IPv6 packet; other packets are skipped. Files are read in
parallel, a file a task. Damaged tails end a file's rows.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Numbers of the formats and protocols.
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
_PROTOCOLS = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 41: "IPv6", 47: "GRE", 50: "ESP", 58: "ICMPv6", 89: "OSPF", 132: "SCTP"}
_ETHERNET, _RAW, _COOKED = 1, 101, 113
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def packets(data: bytes) -> Iterator[tuple[datetime, str, str, str, int]]:
    order, scale = _MAGIC.get(bytes(data[:4]), (None, 1))
    if order is None or len(data) < 24:
        return
    link = struct.unpack_from(f"{order}I", data, 20)[0] & 0xFFFF
    at = 24
    while at + 16 <= len(data):
        seconds, fraction, kept, length = struct.unpack_from(f"{order}4I", data, at)
        frame = memoryview(data)[at + 16 : at + 16 + kept]
        at += 16 + kept
        if len(frame) < kept:
            return
        found = _network(frame, link)
        if found:
            yield (_EPOCH + timedelta(seconds=seconds, microseconds=fraction // scale), *found, length)


def _network(frame: memoryview, link: int) -> tuple[str, str, str] | None:
    if link == _RAW:
        start = 0
    else:
        start = 14 if link == _ETHERNET else 16 if link == _COOKED else -1
        if start < 0 or len(frame) < start:
            return None
        kind = int.from_bytes(frame[start - 2 : start], "big")
        while kind in (0x8100, 0x88A8) and len(frame) >= start + 4:
            kind = int.from_bytes(frame[start + 2 : start + 4], "big")
            start += 4
        if kind not in (0x0800, 0x86DD):
            return None
    ip = frame[start:]
    if len(ip) >= 20 and ip[0] >> 4 == 4:
        source, target, protocol = ip[12:16], ip[16:20], ip[9]
    elif len(ip) >= 40 and ip[0] >> 4 == 6:
        source, target, protocol = ip[8:24], ip[24:40], ip[6]
    else:
        return None
    return str(ipaddress.ip_address(bytes(source))), str(ipaddress.ip_address(bytes(target))), _PROTOCOLS.get(protocol, str(protocol))


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = [pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["Time", "Source", "Destination", "Protocol", "Length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for row in packets(content.as_py()):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, "Time timestamp, Source string, Destination string, Protocol string, Length long")
