"""Which endpoint of a flow is the external candidate and which is the internal host."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.functions.net import ip_in_cidrs, ipv4_number, number_in_cidrs
from netsift.params import PRIVATE_NETWORKS
from netsift.schema import as_flows


def scoped(
    flows: DataFrame, start: str | None, end: str | None, sensors: Iterable[str] = ()
) -> DataFrame:
    """Rows inside the inclusive time range, from the named sensors (all when none is named)."""
    if start and end and not start < end:
        raise ValueError("end must be after start")
    if start:
        flows = flows.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        flows = flows.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    names = sorted(set(sensors))
    return flows.filter(F.col("sensor_id").isin(names)) if names else flows


def role_columns(df: DataFrame, cidrs: Iterable[str] = PRIVATE_NETWORKS) -> DataFrame:
    """Add role columns; they are null where no single side is external.

    The stated direction decides. Addresses are parsed only for rows without one, inside a function over a
    one-element array: generated code around it stays small enough for the JVM to compile, and tests on the
    role do not repeat the parsing.
    """
    cidrs = list(cidrs)
    stated = F.upper("direction")
    known = stated.isin("OUTBOUND", "INBOUND")
    ends = F.array(F.struct(F.col("source_ip").alias("s"), F.col("destination_ip").alias("d")))
    if any(":" in c for c in cidrs):
        read = lambda ip: ip_in_cidrs(ip, cidrs)
        inside = lambda x: F.coalesce(x, F.lit(False))
    else:
        read, inside = ipv4_number, lambda x: number_in_cidrs(x, cidrs)
    pair = lambda f: lambda e: F.struct(f(e["s"]).alias("s"), f(e["d"]).alias("d"))
    sides = F.transform(F.transform(ends, pair(read)), pair(inside))
    decided = F.transform(
        sides,
        lambda e: F.when(e["s"] != e["d"], F.when(e["s"], F.lit("OUTBOUND")).otherwise(F.lit("INBOUND"))),
    )
    direction = F.when(known, stated).when(~known, F.get(decided, F.lit(0)))
    out = F.col("norm_direction") == "OUTBOUND"
    inb = F.col("norm_direction") == "INBOUND"
    pick = lambda a, b: F.when(out, F.col(a)).when(inb, F.col(b))
    return (
        df.withColumn("norm_direction", direction)
        .withColumns(
            {
                "candidate_ip": pick("destination_ip", "source_ip"),
                "host_ip": pick("source_ip", "destination_ip"),
                "service_port": pick("destination_port", "source_port"),
                "internal_port": pick("source_port", "destination_port"),
            }
        )
    )


def orient(flows: DataFrame, cidrs: Iterable[str] = PRIVATE_NETWORKS) -> DataFrame:
    """Flows with a candidate and a host; rows without a clear role are dropped."""
    return role_columns(as_flows(flows), cidrs).filter(F.col("norm_direction").isNotNull())


def classify_direction(
    packets: DataFrame,
    interfaces: dict[str, str] | None = None,
    vlans: dict[int, str] | None = None,
    cidrs: Iterable[str] = PRIVATE_NETWORKS,
) -> DataFrame:
    """Direction by interface map, then VLAN map, then networks, and which of them decided."""
    cidrs = list(cidrs)

    def known(mapping: dict, key: Column) -> Column:
        pairs = [(k, v) for k, v in (mapping or {}).items() if v != "UNKNOWN"]
        if not pairs:
            return F.lit(None).cast("string")
        return F.create_map(*[F.lit(x) for kv in pairs for x in kv])[key]

    by_if = known(interfaces, F.col("interface"))
    by_vlan = known(vlans, F.col("vlan").cast("int"))
    src, dst = ip_in_cidrs("source_ip", cidrs), ip_in_cidrs("destination_ip", cidrs)
    by_net = F.when(src & ~dst, "OUTBOUND").when(dst & ~src, "INBOUND")
    return packets.withColumns(
        {
            "direction": F.coalesce(by_if, by_vlan, by_net, F.lit("UNKNOWN")),
            "direction_source": F.when(by_if.isNotNull(), "INTERFACE")
            .when(by_vlan.isNotNull(), "VLAN")
            .when(by_net.isNotNull(), "CIDR")
            .otherwise("NONE"),
        }
    )
