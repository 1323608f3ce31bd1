"""Schemas and feature layouts of the flow tables."""

from __future__ import annotations

from pyspark.sql import types as T

from siltstone.operators.features import Block, FeatureSpec

# Column names of the flow table, as its files have them.
FLOW_FEATURES = (
    "flow_psh fpkts_per_second total_bhlen flow_iat_max backward_packet_length_max forward_iat_std total_length_of_forward_packets"
    " backward_packet_length_std forward_iat_min total_fhlen total_length_of_backward_packets total_backward_packets forward_iat_max"
    " forward_packet_length_mean backward_iat_min flow_iat_min backward_packet_length_min flow_syn bpkts_per_second flow_protocol"
    " forward_iat_total forward_packet_length_min backward_iat_max flow_iat_total flow_urg flow_fin flow_ece forward_packet_length_std"
    " backward_packet_length_mean flow_iat_std flow_ack backward_iat_total backward_iat_mean flow_rst total_forward_packets"
    " flow_packets_per_second backward_iat_std flow_cwr forward_iat_mean flow_iat_mean forward_packet_length_max"
).split()
STAGES = ["reconnaissance", "infection", "action"]
# The decayed-window statistics table, windows first.
WINDOWS = ["100ms", "500ms", "1.5s", "10s", "1min"]
WINDOW_STREAMS = ["SrcMAC_IP", "SrcIP", "Channel", "Socket"]
WINDOW_STATISTICS = ["w", "mu", "sigma", "max", "min"]
JITTER_STATISTICS = ["mu", "sigma", "max"]


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def flow_schema(with_id: bool = False) -> T.StructType:
    first = [T.StructField("id", T.IntegerType(), False)] if with_id else []
    return T.StructType([*first, *_doubles([*FLOW_FEATURES, *STAGES])])


def window_columns() -> list[str]:
    """115 names: every statistic of every window."""
    names = [f"{s}_{x}" for s in WINDOW_STREAMS for x in WINDOW_STATISTICS] + [f"Jitter_{x}" for x in JITTER_STATISTICS]
    return [f"{n}_{w}" for w in WINDOWS for n in names]


def window_schema() -> T.StructType:
    return T.StructType(_doubles(window_columns()))


PACKET_SCHEMA = T.StructType(
    [T.StructField("Time", T.TimestampType()), *[T.StructField(n, T.StringType()) for n in ("Source", "Destination", "Protocol")], T.StructField("Length", T.LongType())]
)


def _names(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(","))


# The columns of each feature block, in the order in which the embeddings take them.
_FLAGS = _names("flow_psh, flow_syn, flow_urg, flow_fin, flow_ece, flow_ack, flow_rst, flow_cwr")
_FLOW_TIMES_9 = _names("flow_iat_max, forward_iat_std, forward_iat_min, flow_iat_min, backward_iat_min, backward_iat_max, flow_iat_total, forward_iat_mean, flow_iat_mean")
_FLOW_LENGTHS_9 = _names(
    "total_length_of_forward_packets, backward_packet_length_max, backward_packet_length_std, forward_packet_length_mean, forward_packet_length_min,"
    " forward_packet_length_std, backward_packet_length_mean, backward_packet_length_min, total_length_of_backward_packets"
)
_FLOW_COUNTS_HEADERS = _names("fpkts_per_second, bpkts_per_second, total_bhlen, total_fhlen, total_backward_packets, total_forward_packets, flow_packets_per_second")
_FLOW_TIMES = _names("flow_iat_max, flow_iat_min, flow_iat_mean, flow_iat_total, flow_iat_std")
_FORWARD_TIMES = _names("forward_iat_max, forward_iat_min, forward_iat_mean, forward_iat_total, forward_iat_std")
_BACKWARD_TIMES = _names("backward_iat_max, backward_iat_min, backward_iat_mean, backward_iat_total, backward_iat_std")
_FORWARD_LENGTHS = _names("forward_packet_length_mean, forward_packet_length_min, forward_packet_length_max, forward_packet_length_std")
_BACKWARD_LENGTHS = _names("backward_packet_length_mean, backward_packet_length_min, backward_packet_length_max, backward_packet_length_std")
_FLOW_COUNTS_LENGTHS = _names(
    "fpkts_per_second, bpkts_per_second, total_forward_packets, total_backward_packets, total_length_of_forward_packets, total_length_of_backward_packets, flow_packets_per_second"
)
_PORT_TIMES = _names(
    "Flow Duration, Flow IAT Mean, Flow IAT Std, Flow IAT Max, Flow IAT Min, Fwd IAT Total, Fwd IAT Mean, Fwd IAT Std, Fwd IAT Max, Fwd IAT Min, Bwd IAT Total, Bwd IAT Mean,"
    " Bwd IAT Std, Bwd IAT Max, Bwd IAT Min, Active Mean, Active Std, Active Max, Active Min, Idle Mean, Idle Std, Idle Max, Idle Min"
)
_PORT_LENGTHS = _names(
    "Total Length of Fwd Packets, Total Length of Bwd Packets, Fwd Packet Length Max, Fwd Packet Length Min, Fwd Packet Length Mean, Fwd Packet Length Std, Bwd Packet Length Max,"
    " Bwd Packet Length Min, Bwd Packet Length Mean, Bwd Packet Length Std, Packet Length Mean, Packet Length Std, Packet Length Variance, Avg Fwd Segment Size, Avg Bwd Segment Size"
)
_PORT_COUNTS = _names(
    "Total Fwd Packets, Total Backward Packets, Flow Bytes/s, Flow Packets/s, Fwd Packets/s, Bwd Packets/s, Fwd Header Length, Bwd Header Length, Down/Up Ratio, Average Packet Size,"
    " Fwd Avg Bytes/Bulk, Fwd Avg Packets/Bulk, Fwd Avg Bulk Rate, Bwd Avg Bytes/Bulk, Bwd Avg Packets/Bulk, Bwd Avg Bulk Rate, Subflow Fwd Packets, Subflow Fwd Bytes,"
    " Subflow Bwd Packets, Subflow Bwd Bytes, Init_Win_bytes_forward, Init_Win_bytes_backward, act_data_pkt_fwd, min_seg_size_forward"
)
_PORT_FLAGS = _names(
    "Fwd PSH Flags, Bwd PSH Flags, Fwd URG Flags, Bwd URG Flags, FIN Flag Count, SYN Flag Count, RST Flag Count, PSH Flag Count, ACK Flag Count, URG Flag Count, CWE Flag Count, ECE Flag Count"
)
_PROTOCOL_TIMES = _names(
    "Flow IAT Max, Flow IAT Min, Flow IAT Mean, Flow IAT Std, Fwd IAT Total, Fwd IAT Mean, Fwd IAT Max, Fwd IAT Min, Bwd IAT Total, Bwd IAT Mean, Bwd IAT Max, Bwd IAT Min"
)
_PROTOCOL_LENGTHS = _names(
    "Total Length of Fwd Packets, Total Length of Bwd Packets, Fwd Packet Length Max, Fwd Packet Length Min, Fwd Packet Length Mean, Fwd Packet Length Std, Bwd Packet Length Max,"
    " Bwd Packet Length Min, Bwd Packet Length Mean, Bwd Packet Length Std"
)
_PROTOCOL_COUNTS = _names("Total Fwd Packets, Total Backward Packets, Flow Packets/s, Fwd Packets/s, Bwd Packets/s, Subflow Fwd Packets, Subflow Bwd Packets")
_PROTOCOL_FLAGS = _names("FIN Flag Count, SYN Flag Count, RST Flag Count, PSH Flag Count, ACK Flag Count, URG Flag Count, CWE Flag Count, ECE Flag Count")


def _spec(category: str | None, *blocks: tuple[str, ...], plain: tuple[str, ...] = ()) -> FeatureSpec:
    first = (Block("onehot", (category,)),) if category else ()
    return FeatureSpec((*first, *(Block("scale", b) for b in blocks), *((Block("plain", plain),) if plain else ())))


_LAYOUTS = {
    "a": _spec("flow_protocol", _FLOW_TIMES_9, _FLOW_LENGTHS_9, _FLOW_COUNTS_HEADERS, plain=_FLAGS),
    "b": _spec("flow_protocol", _FLOW_TIMES, _FORWARD_TIMES, _BACKWARD_TIMES, _FORWARD_LENGTHS, _BACKWARD_LENGTHS, _FLOW_COUNTS_LENGTHS, plain=_FLAGS),
    "c": _spec("flow_protocol", (*_FLOW_TIMES, *_FORWARD_TIMES, *_BACKWARD_TIMES), (*_FORWARD_LENGTHS, *_BACKWARD_LENGTHS), _FLOW_COUNTS_LENGTHS, plain=_FLAGS),
    "d": _spec("flow_protocol", _FLOW_TIMES_9, _FLOW_LENGTHS_9, (*_FLOW_COUNTS_HEADERS, *_FLAGS)),
    "port": _spec("Destination Port", _PORT_TIMES, _PORT_LENGTHS, _PORT_COUNTS, plain=_PORT_FLAGS),
    "protocol": _spec("Protocol", _PROTOCOL_TIMES, _PROTOCOL_LENGTHS, _PROTOCOL_COUNTS, plain=_PROTOCOL_FLAGS),
    "window": _spec(
        None,
        tuple(f"{s}_{x}_100ms" for s in ("SrcMAC_IP", "SrcIP", "Channel") for x in WINDOW_STATISTICS),
        tuple(f"Socket_{x}_100ms" for x in WINDOW_STATISTICS),
        tuple(f"Jitter_{x}_100ms" for x in JITTER_STATISTICS),
    ),
}


def flow_spec(layout: str = "a") -> FeatureSpec:
    """The feature layout of a table, block by block.

    Botnet flows: a: protocol one-hot; 9 times, 9 lengths, 7 counts with header lengths, scaled; flags plain. b: 15 times in three
    blocks, 8 lengths in two, 7 counts with total lengths; flags plain. c: the columns of b in one block of times and one of
    lengths. d: as a with the flags scaled among the counts. Others: port: flows with a one-hot destination port. protocol: flows
    with a one-hot protocol number. window: statistics of the 100 ms window, without categories and flags.
    """
    return _LAYOUTS[layout]


def labelled_schema(layout: str) -> T.StructType:
    """Columns of a labelled table of the layouts port and protocol; its label is text."""
    columns = [c for b in _LAYOUTS[layout].blocks for c in b.columns]
    return T.StructType([*_doubles(columns), T.StructField("Label", T.StringType())])
