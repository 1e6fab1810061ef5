"""Scalar rules on names, payloads and addresses."""

from __future__ import annotations

import ipaddress
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Top-level payload keys that describe state; all others are attributes.
STATE_KEYS = [
    "phase", "reason", "conditions", "containers", "deletion_timestamp", "host_ip", "pod_ips", "node_info", "node_name",
    "k8s.pod.phase", "k8s.pod.status_reason", "k8s.node.condition_ready", "k8s.node.condition_memory_pressure", "k8s.node.condition_disk_pressure",
    "k8s.node.condition_pid_pressure", "k8s.node.condition_network_unavailable", "container.status", "container.status.reason", "k8s.node.name", "container.image.tag",
]

# By entity type the payload keys that hold its name and namespace, the first present counts.
NAME_KEYS = {"k8s.pod": ["name", "k8s.pod.name"], "k8s.node": ["name", "k8s.node.name"], "container": ["name", "k8s.container.name"], "service": ["name"]}
NAMESPACE_KEYS = {"k8s.pod": ["namespace", "k8s.namespace.name"], "container": ["k8s.namespace.name"], "service": ["namespace"]}

# By entity type the payload keys that are shown, and those of them whose text a sender chose; all other keys are withheld.
SHOWN_KEYS = {
    "k8s.pod": ["name", "namespace", "node_name", "phase", "reason", "deletion_timestamp", "owner", "conditions", "containers", "k8s.pod.name", "k8s.namespace.name", "k8s.node.name", "k8s.pod.phase", "k8s.pod.status_reason", "k8s.workload.kind", "k8s.workload.name", "k8s.deployment.name", "k8s.replicaset.name", "k8s.statefulset.name", "pod.creation_timestamp"],
    "k8s.node": ["name", "labels", "conditions", "k8s.node.name", "node.creation_timestamp", "k8s.node.condition_ready", "k8s.node.condition_memory_pressure", "k8s.node.condition_disk_pressure", "k8s.node.condition_pid_pressure", "k8s.node.condition_network_unavailable"],
    "host": ["host.arch", "host.type", "os.type", "host.cpu.model.name", "cloud.provider", "cloud.platform", "cloud.region", "cloud.availability_zone"],
    "container": ["name", "pod_uid", "k8s.container.name", "k8s.pod.name", "k8s.namespace.name", "k8s.node.name", "container.image.name", "container.image.tag", "container.status", "container.status.reason", "container.creation_timestamp"],
    "service": ["name", "namespace"],
    "service.instance": ["service.version"],
}
TEXT_KEYS = {
    "k8s.pod": ["name", "namespace", "node_name", "k8s.pod.name", "k8s.namespace.name", "k8s.node.name", "k8s.workload.name", "k8s.deployment.name", "k8s.replicaset.name", "k8s.statefulset.name"],
    "k8s.node": ["name", "k8s.node.name"], "container": ["name", "k8s.container.name", "k8s.pod.name", "k8s.namespace.name", "k8s.node.name"],
    "service": ["name", "namespace"], "service.instance": ["service.version"],
}

# Blocks of the IANA special-purpose address registries that are not globally reachable.
NOT_GLOBAL = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48",
    "100::/64", "100:0:0:1::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10",
]
GLOBAL_V6 = ipaddress.ip_network("2000::/3")
_BLOCKS = [ipaddress.ip_network(x) for x in NOT_GLOBAL]


def printable(x: Column) -> Column:
    """At most 253 bytes, without control or format characters and without an endpoint's id."""
    return (F.octet_length(x) <= 253) & ~x.rlike("[\\p{Cc}\\p{Cf}\\u2028\\u2029]") & ~x.rlike("topo\\.endpoint:[0-9a-f]{32}")


def redact_endpoints(x: Column) -> Column:
    return F.regexp_replace(x, "topo\\.endpoint:[0-9a-f]{32}", "topo.endpoint:withheld")


def contains_folded(x: Column, part: str) -> Column:
    return F.lower(x).contains(part.lower())


def producer_ok(x: Column) -> Column:
    return x.rlike("^[A-Za-z0-9._:/-]{1,64}$")


def ratio_reached(covered: Column, total: Column, numerator: int, denominator: int) -> Column:
    """covered / total >= numerator / denominator, in integers."""
    return covered * denominator >= total * numerator


def canonical_address(text: str | None, cluster: str) -> tuple[str, str] | None:
    """(realm, address): canonical form of an address, ``global`` or the cluster's realm; None if refused."""
    try:
        if text is None or "%" in text:
            return None
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    if a.is_loopback or a.is_unspecified or a.is_link_local or a.is_multicast or str(a) == "255.255.255.255":
        return None
    special = any(a in b for b in _BLOCKS if b.version == a.version)
    is_global = not special and (a.version == 4 or a in GLOBAL_V6)
    return ("global" if is_global else f"k8s/{cluster}"), str(a)


def address_columns(address: Column, cluster: Column) -> Column:
    """struct(realm, address) of a column of addresses; Spark has no function for them, so in Arrow batches."""

    @F.pandas_udf("realm string, address string")
    def run(a: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([canonical_address(x, y) or (None, None) for x, y in zip(a, c)], columns=["realm", "address"])

    return run(address, cluster)


def payload_object(payload: bytes | None) -> dict | None:
    """The payload as a JSON object with numbers kept as text; empty is {}, anything else None."""
    if not payload:
        return {}
    try:
        text = bytes(payload).decode()
        if not text.lstrip(" \t\r\n").startswith("{"):
            return None
        return json.loads(text, parse_int=lambda x: ("n", x), parse_float=lambda x: ("n", x), parse_constant=lambda x: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return None


def description_change(a: Column, b: Column) -> Column:
    """struct(kind, state_keys, attribute_keys) between two payloads: null kind if they say the same.

    Nested values are compared as values, which needs a parser; only changed payloads get here.
    """

    @F.pandas_udf("kind string, state_keys string, attribute_keys string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y):
            m, n = payload_object(p), payload_object(q)
            if m is None or n is None:
                rows.append(("opaque", "", ""))
                continue
            keys = sorted(k for k in m.keys() | n.keys() if k not in m or k not in n or m[k] != n[k])
            rows.append(("keys" if keys else None, ",".join(k for k in keys if k in STATE_KEYS), ",".join(k for k in keys if k not in STATE_KEYS)))
        return pd.DataFrame(rows, columns=["kind", "state_keys", "attribute_keys"])

    return run(a, b)


def _first_text(payload: Column, keys: list[str]) -> Column:
    """The first of the keys that a payload, one JSON object, holds as text that is not empty."""
    text = payload.cast("string")
    if not keys:
        return F.lit(None).cast("string")
    # A value that is no string keeps its brackets or digits in JSON: only quoted values are names.
    raw = F.from_json(text, "map<string,variant>")
    kind = lambda k: F.schema_of_variant(F.element_at(raw, k))
    value = lambda k: F.get_json_object(text, f"$['{k}']")
    return F.coalesce(*[F.when((kind(k) == "STRING") & (value(k) != ""), value(k)) for k in keys])


def payload_name(payload: Column, entity_type: str) -> Column:
    """The name that a description gives an entity of a type, or null."""
    return _first_text(payload, NAME_KEYS.get(entity_type, []))


def payload_namespace(payload: Column, entity_type: str) -> Column:
    return _first_text(payload, NAMESPACE_KEYS.get(entity_type, []))


def shown_payload(payload: Column, entity_type: str) -> Column:
    """struct(shown, withheld): the keys of a flat payload that may be shown, as JSON with sorted keys, and the names of the others, sorted.

    A sender's text that may not be printed is null and named among the withheld; what is not one JSON object is withheld whole.
    """
    allowed, text = SHOWN_KEYS.get(entity_type, []), TEXT_KEYS.get(entity_type, [])
    m = F.from_json(payload.cast("string"), "map<string,string>")
    bad = lambda k, v: k.isin(text) & ~printable(v)
    entries = F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: k.isin(allowed))))
    kept = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.when(~F.coalesce(bad(e["key"], e["value"]), F.lit(False)), e["value"]).alias("value")))
    held = F.map_keys(F.map_filter(m, lambda k, v: ~k.isin(allowed) | F.coalesce(bad(k, v), F.lit(False))))
    return F.struct(F.coalesce(F.to_json(F.map_from_entries(kept)), F.lit("{}")).alias("shown"), F.coalesce(F.array_join(F.array_sort(held), ","), F.lit("")).alias("withheld"))
