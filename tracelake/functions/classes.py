"""Classifications: enumerations, duration buckets, utilisation roles, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public kernel enumerations, position = number.
WAIT_REASONS = (
    "Executive", "FreePage", "PageIn", "PoolAllocation", "DelayExecution", "Suspended",
    "UserRequest", "WrExecutive", "WrFreePage", "WrPageIn", "WrPoolAllocation",
    "WrDelayExecution", "WrSuspended", "WrUserRequest", "WrEventPair", "WrQueue",
    "WrLpcReceive", "WrLpcReply", "WrVirtualMemory", "WrPageOut", "WrRendezvous",
    "WrKeyedEvent", "WrTerminated", "WrProcessInSwap", "WrCpuRateControl", "WrCalloutStack",
    "WrKernel", "WrResource", "WrPushLock", "WrMutex", "WrQuantumEnd", "WrDispatchInt",
    "WrPreempted", "WrYieldExecution", "WrFastMutex", "WrGuardedMutex", "WrRundown",
    "WrAlertByThreadId", "WrDeferredPreempt", "WrPhysicalFault",
)
WAIT_MODES = ("KernelMode", "UserMode")
THREAD_STATES = (
    "Initialized", "Ready", "Running", "Standby", "Terminated", "Waiting", "Transition",
    "DeferredReady", "GateWaitObsolete", "WaitingForProcessInSwap",
)
# Switch-out reasons of a thread that could have kept running.
PREEMPTION_REASONS = (
    "wrquantumend", "quantumend", "wrdispatchint", "dispatchint", "wrpreempted", "preempted",
    "wryieldexecution", "yieldexecution", "30", "31", "32", "33",
)
# Spellings of the waiting state.
WAIT_STATES = ("wait", "waiting", "5")
# Upper bound of the last duration bucket.
OPEN_END_US = 99_999_999


def enum_name(number: Column, names: Sequence[str]) -> Column:
    """Name at ``number``; a number outside the enumeration keeps its digits, null is blank."""
    inside = (number >= 0) & (number < len(names))
    named = F.get(F.array(*[F.lit(n) for n in names]), F.when(inside, number).cast("int"))
    return F.when(number.isNull(), F.lit("")).otherwise(F.coalesce(named, number.cast("string")))


def duration_bucket(duration_us: Column) -> Column:
    """Number of the log-2 bucket: 0 for below 1, k for [2^(k-1), 2^k), at most 16."""
    whole = F.floor(duration_us)
    return (
        F.when(whole <= 0, F.lit(0))
        .otherwise(F.least(F.length(F.bin(whole)), F.lit(16)))
        .cast("int")
    )


def bucket_low(bucket: Column) -> Column:
    return F.when(bucket == 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), bucket - 1)).cast("bigint")


def bucket_high(bucket: Column) -> Column:
    return (
        F.when(bucket == 0, F.lit(1))
        .when(bucket >= 16, F.lit(OPEN_END_US))
        .otherwise(F.pow(F.lit(2.0), bucket))
        .cast("bigint")
    )


def utilisation_role(percent: Column) -> Column:
    return (
        F.when(percent >= 80, F.lit("Saturated"))
        .when(percent >= 20, F.lit("Active"))
        .when(percent >= 2, F.lit("Low activity"))
        .otherwise(F.lit("Idle"))
    )


def affinity_status(events: Column, top_percent: Column) -> Column:
    return (
        F.when(events < 10, F.lit("low confidence"))
        .when(top_percent >= 90, F.lit("affinity working"))
        .otherwise(F.lit("affinity not working"))
    )


def journey_confidence(proto: Column, complete: Column) -> Column:
    return (
        F.when(proto == "tcp", F.when(complete, F.lit("high")).otherwise(F.lit("medium")))
        .when(proto == "udp", F.when(complete, F.lit("medium")).otherwise(F.lit("low")))
        .otherwise(F.lit("low"))
    )


def percent_text(value: Column) -> Column:
    """Display form of a percentage: fewer decimals as it grows."""
    return (
        F.when(value >= 10, F.format_string("%.1f%%", value))
        .when(value >= 0.01, F.format_string("%.2f%%", value))
        .otherwise(F.format_string("%.4f%%", value))
    )


def number_text(value: Column) -> Column:
    """Display form of a whole number with thousands separators."""
    return F.format_number(value, 0)
