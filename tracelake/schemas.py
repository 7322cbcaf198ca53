"""Event classes: typed schemas, accepted class spellings and accepted field spellings.

Every table carries ``trace_id``. Unsigned 64-bit values are stored as ``bigint`` holding the
same 64 bits, which keeps equality and grouping exact; cast with ``functions.ids.unsigned``
where order matters.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

LONG, INT, TEXT, REAL = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
STACK = T.ArrayType(LONG)

_BASE = {"seq": LONG, "qpc": LONG, "cpu": INT}
_HEADER = {**_BASE, "process_name": TEXT, "pid": LONG, "tid": LONG}
_ENDS = {"local_addr": TEXT, "local_port": LONG, "remote_addr": TEXT, "remote_port": LONG}
_TCP = {**_HEADER, **_ENDS, "size": LONG, "seq_no": LONG, "conn_id": LONG}
_HANDSHAKE = {**_HEADER, **_ENDS, "size": LONG, "mss": LONG, "rcv_win": LONG, "seq_no": LONG, "conn_id": LONG}
_UDP = {**_HEADER, **_ENDS, "size": LONG}
_SOCKET_IO = {**_HEADER, "socket_handle": LONG, "size": LONG, "completion_status": LONG}
_SOCKET_END = {**_HEADER, "socket_handle": LONG, **_ENDS}
_INTERRUPT = {
    "seq": LONG, "qpc": LONG, "initial_qpc": LONG, "cpu": INT, "routine": LONG, "type": TEXT,
    "duration_qpc": LONG, "duration_us": REAL, "stack": STACK,
}
_QUIC_PACKET = {**_HEADER, "connection_id": LONG, "packet_number": LONG, "size": LONG}

_CLASSES: dict[str, dict[str, T.DataType]] = {
    "sampled_profile": {
        **_BASE, "pid": LONG, "tid": LONG, "payload_tid": LONG, "address": LONG,
        "weight": LONG, "profile_weight": LONG, "stack": STACK,
    },
    "cswitch": {
        **_BASE, "new_tid": LONG, "old_tid": LONG, "new_pid": LONG, "old_pid": LONG,
        "wait_reason": TEXT, "wait_mode": TEXT, "old_state": TEXT,
        "new_priority": INT, "old_priority": INT, "stack": STACK,
    },
    "dpc": _INTERRUPT,
    "isr": _INTERRUPT,
    "process": {
        **_BASE, "pid": LONG, "parent_pid": LONG, "session_id": LONG,
        "image_file_name": TEXT, "command_line": TEXT, "type": TEXT,
    },
    "thread": {**_BASE, "pid": LONG, "tid": LONG, "thread_name": TEXT, "type": TEXT},
    "image": {
        **_BASE, "pid": LONG, "image_base": LONG, "image_size": LONG, "file_name": TEXT,
        "type": TEXT, "time_date_stamp": LONG, "pdb_guid": TEXT, "pdb_age": LONG, "pdb_name": TEXT,
    },
    "imageid_rsds": {
        **_BASE, "pid": LONG, "image_base": LONG, "pdb_guid": TEXT, "pdb_age": LONG,
        "pdb_name": TEXT, "pdb_full_path": TEXT,
    },
    "readythread": {
        **_BASE, "pid": LONG, "tid": LONG, "readied_tid": LONG, "readying_tid": LONG,
        "readying_pid": LONG, "adjust_reason": INT, "adjust_increment": INT, "flag": INT,
        "stack": STACK,
    },
    "tcpip_recv": _TCP,
    "tcpip_send": _TCP,
    "tcpip_retransmit": {**_TCP, "retransmit_count": LONG},
    "tcpip_connect": _HANDSHAKE,
    "tcpip_accept": _HANDSHAKE,
    "udp_recv": _UDP,
    "udp_send": _UDP,
    "afd_recv": _SOCKET_IO,
    "afd_send": _SOCKET_IO,
    "afd_connect": _SOCKET_END,
    "afd_accept": _SOCKET_END,
    "afd_close": {**_HEADER, "socket_handle": LONG},
    "ndis_drops": {**_HEADER, "miniport": TEXT, "reason": TEXT, "size": LONG},
    "packet_capture": {
        **_HEADER, "direction": TEXT, "miniport": TEXT, "packet_hex": TEXT, "size": LONG,
    },
    "http_recv": {**_HEADER, "request_id": LONG, "connection_id": LONG, "verb": TEXT, "url": TEXT},
    "http_deliver": {**_HEADER, "request_id": LONG, "url_group_id": LONG},
    "http_send": {**_HEADER, "request_id": LONG, "status_code": LONG, "content_length": LONG},
    "http_close": {**_HEADER, "request_id": LONG},
    "quic_conn_created": {
        **_HEADER, "connection_id": LONG, "cid": TEXT, "local_addr": TEXT, "remote_addr": TEXT,
    },
    "quic_conn_closed": {**_HEADER, "connection_id": LONG},
    "quic_packet_recv": _QUIC_PACKET,
    "quic_packet_send": _QUIC_PACKET,
    "quic_ack_recv": {
        **_HEADER, "connection_id": LONG, "ack_delay": LONG, "largest_acknowledged": LONG,
    },
    "disk_io": {
        **_BASE, "kind": TEXT, "disk_number": LONG, "byte_offset": LONG, "transfer_size": LONG,
        "pid": LONG, "file_name": TEXT, "elapsed_us": LONG,
    },
    "trace_header": {
        **_BASE, "perf_freq": LONG, "cpu_count": INT, "timer_resolution": INT,
        "start_time": LONG, "end_time": LONG, "boot_time": LONG, "cpu_mhz": INT,
        "pointer_size": INT, "buffers_written": INT, "events_lost": INT,
    },
    "pktmon_layer": {
        "seq": LONG, "ts_us": LONG, "direction": TEXT, "packet_hex": TEXT, "size": LONG,
        "captured_size": LONG, "packet_group": LONG, "packet_number": LONG, "appearance": LONG,
        "component": INT, "edge": INT, "boundary": T.BooleanType(), "path_index": INT,
    },
}

EVENT_CLASSES = tuple(_CLASSES)


def event_schema(event_class: str) -> T.StructType:
    """Schema of one event class, ``trace_id`` first."""
    fields = _CLASSES[canonical_event_class(event_class)]
    return T.StructType(
        [T.StructField("trace_id", TEXT), *[T.StructField(n, t) for n, t in fields.items()]]
    )


# Producer and verb spellings, written without case and separators. A class is
# named by a producer prefix followed by one of the verbs.
_PREFIXES = {
    "tcpip": ("tcpip",),
    "udp": ("udpip", "udp"),
    "afd": ("afd",),
    "http": ("httpservice", "httprequesttracetask", "http"),
    "quic": ("msquic", "quic"),
    "process": ("process",),
    "thread": ("thread",),
    "image": ("image",),
    "perfinfo": ("perfinfo", ""),
    "ndis": ("ndis", ""),
}
_LIFECYCLE = ("", "start", "end", "dcstart", "dcend")
_VERBS = {
    "tcpip_recv": ("tcpip", ("recv",)),
    "tcpip_send": ("tcpip", ("send",)),
    "tcpip_retransmit": ("tcpip", ("retransmit",)),
    "tcpip_connect": ("tcpip", ("connect",)),
    "tcpip_accept": ("tcpip", ("accept",)),
    "udp_recv": ("udp", ("recv",)),
    "udp_send": ("udp", ("send",)),
    "afd_recv": ("afd", ("recv",)),
    "afd_send": ("afd", ("send",)),
    "afd_connect": ("afd", ("connect",)),
    "afd_accept": ("afd", ("accept",)),
    "afd_close": ("afd", ("close",)),
    "http_recv": ("http", ("recv", "recvreq", "recvrequest")),
    "http_deliver": ("http", ("deliver", "deliverrequest")),
    "http_send": ("http", ("send", "sendresponse", "fastsend", "fastresponse")),
    "http_close": ("http", ("close", "closerequest", "srvdreq")),
    "quic_conn_created": ("quic", ("connection", "connectioncreated", "conncreated")),
    "quic_conn_closed": ("quic", ("connectionclosed", "connectiondestroyed", "connclosed")),
    "quic_packet_recv": ("quic", ("packetrecv", "packetreceived", "connpacketrecv")),
    "quic_packet_send": ("quic", ("packetsend", "packetsent", "connpacketsent")),
    "quic_ack_recv": ("quic", ("ackrecv", "ackreceived", "ackprocessed")),
    "process": ("process", (*_LIFECYCLE, "defunct")),
    "thread": ("thread", (*_LIFECYCLE, "setname")),
    "image": ("image", ("", "load", "unload", "dcstart", "dcend")),
    "imageid_rsds": ("image", ("idrsds", "iddbgidrsds")),
    "dpc": ("perfinfo", ("dpc", "threadeddpc", "timerdpc")),
    "isr": ("perfinfo", ("isr",)),
    "readythread": ("thread", ("ready", "readythread")),
    "ndis_drops": ("ndis", ("drop", "drops", "packetdrop")),
    "packet_capture": ("ndis", ("packetcapture", "packetcapturerecv", "packetcapturesend")),
    "sampled_profile": ("perfinfo", ("sampledprofile", "dumper")),
    "cswitch": ("perfinfo", ("cswitch", "cswitchevents")),
}


def _spelling(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", re.sub(r"_df$", "", name.strip().lower()))


CLASS_SPELLINGS: dict[str, str] = {
    prefix + verb: event_class
    for event_class, (family, verbs) in _VERBS.items()
    for prefix in _PREFIXES[family]
    for verb in verbs
}
CLASS_SPELLINGS["readythread"] = "readythread"
CLASS_SPELLINGS.update({_spelling(name): name for name in _CLASSES})
CLASS_SPELLINGS.pop("", None)


def canonical_event_class(name: str) -> str:
    """Table name for any accepted spelling of an event class."""
    try:
        return CLASS_SPELLINGS[_spelling(str(name))]
    except KeyError:
        raise KeyError(f"unsupported event class: {name!r}") from None


# The spellings under which producers deliver each field, best first.
FIELD_SPELLINGS: dict[str, tuple[str, ...]] = {
    "seq": ("EventSequence",),
    "qpc": ("TimeStampQpc", "TimeStamp"),
    "cpu": ("CPU",),
    "initial_qpc": ("InitialTimeQpc", "InitialTime"),
    "duration_qpc": ("DurationQpc",),
    "duration_us": ("DurationUs", "Duration_us", "Duration (us)", "DPC_us", "ISR_us"),
    "routine": ("Routine",),
    "type": ("Type",),
    "stack": ("Stack",),
    "pid": ("PID", "ProcessId"),
    "tid": ("ThreadID", "ThreadId", "TID"),
    "payload_tid": ("PayloadThreadId",),
    "process_name": ("Process Name", "ProcessName"),
    "address": ("InstructionPointer",),
    "weight": ("Weight", "Count"),
    "profile_weight": ("ProfileWeight",),
    "new_tid": ("NewTID", "NewThreadId", "New TID"),
    "old_tid": ("OldTID", "OldThreadId", "Old TID"),
    "new_pid": ("NewPID", "NewProcessId", "New PID"),
    "old_pid": ("OldPID", "OldProcessId", "Old PID"),
    "wait_reason": ("WaitReason", "OldThreadWaitReason", "Wait Reason"),
    "wait_mode": ("WaitMode",),
    "old_state": ("OldThreadState", "OldState"),
    "new_priority": ("NewPriority",),
    "old_priority": ("OldPriority",),
    "parent_pid": ("ParentId",),
    "session_id": ("SessionId",),
    "image_file_name": ("ImageFileName",),
    "command_line": ("CommandLine",),
    "thread_name": ("ThreadName",),
    "image_base": ("ImageBase",),
    "image_size": ("ImageSize",),
    "file_name": ("FileName",),
    "time_date_stamp": ("TimeDateStamp",),
    "pdb_guid": ("PdbGuid",),
    "pdb_age": ("PdbAge",),
    "pdb_name": ("PdbName",),
    "pdb_full_path": ("PdbFullPath",),
    "readied_tid": ("ReadiedThreadId",),
    "readying_tid": ("ReadyingThreadId",),
    "readying_pid": ("ReadyingProcessId",),
    "adjust_reason": ("AdjustReason",),
    "adjust_increment": ("AdjustIncrement",),
    "flag": ("Flag",),
    "local_addr": ("LocalAddr", "LocalAddress"),
    "local_port": ("LocalPort",),
    "remote_addr": ("RemoteAddr", "RemoteAddress"),
    "remote_port": ("RemotePort",),
    "size": ("Size", "NumBytes", "BytesSent", "BytesRecv", "FragmentSize"),
    "seq_no": ("SeqNo", "SeqNum", "SequenceNumber"),
    "conn_id": ("ConnId", "Tcb", "TCB"),
    "mss": ("MSS",),
    "rcv_win": ("RcvWin",),
    "retransmit_count": ("RetransmitCount",),
    "socket_handle": ("SocketHandle", "Endpoint"),
    "completion_status": ("CompletionStatus",),
    "miniport": ("MiniportName", "FriendlyName"),
    "reason": ("Reason",),
    "direction": ("Direction",),
    "packet_hex": ("PacketBytes", "Fragment"),
    "request_id": ("RequestId", "RequestObj"),
    "connection_id": ("ConnectionId", "ConnectionObj", "Connection", "CorrelationId"),
    "verb": ("Verb",),
    "url": ("Url",),
    "url_group_id": ("UrlGroupId", "UrlGroup"),
    "status_code": ("StatusCode",),
    "content_length": ("ContentLength",),
    "cid": ("CID",),
    "packet_number": ("PacketNumber",),
    "ack_delay": ("AckDelay",),
    "largest_acknowledged": ("LargestAcknowledged",),
    "kind": ("Kind", "Operation"),
    "disk_number": ("DiskNumber",),
    "byte_offset": ("ByteOffset",),
    "transfer_size": ("TransferSize",),
    "elapsed_us": ("ElapsedMicros",),
    "perf_freq": ("PerfFreq",),
    "cpu_count": ("NumberOfProcessors",),
    "cpu_mhz": ("CpuSpeedMHz", "CpuSpeedInMHz"),
    "timer_resolution": ("TimerResolution",),
    "start_time": ("StartTime",),
    "end_time": ("EndTime",),
    "boot_time": ("BootTime",),
    "pointer_size": ("PointerSize",),
    "buffers_written": ("BuffersWritten",),
    "events_lost": ("EventsLost",),
}
