"""Who is at either end of an exchange: pods, services, processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Rows of a dimension snapshot that may be broadcast; beyond it the join is left to the optimizer.
BROADCAST_ROWS = 200_000


def dimension(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is checked to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def one_each(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the same in every run: the one with the largest values."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("__row")).select(key, "__row.*")


def with_dst(x: DataFrame, pods: DataFrame, services: DataFrame) -> DataFrame:
    """x(ip, port) with dst: the pod at the ip, else the service, else ip:port, else unknown. A pod wins over a service."""
    p = dimension(one_each(pods.select(F.col("ip").alias("p_ip"), F.col("namespace").alias("p_ns"), F.col("name").alias("p_name")), "p_ip"))
    s = dimension(one_each(services.select(F.col("ip").alias("s_ip"), F.col("namespace").alias("s_ns"), F.col("name").alias("s_name")), "s_ip"))
    address = F.concat(F.col("ip"), F.lit(":"), F.col("port").cast("string"))
    named = x.join(p, F.col("ip") == F.col("p_ip"), "left").join(s, F.col("ip") == F.col("s_ip"), "left")
    found = F.coalesce(F.concat("p_ns", F.lit("/"), "p_name"), F.concat("s_ns", F.lit("/"), "s_name"))
    return named.withColumn("dst", F.coalesce(found, address, F.lit("unknown"))).drop("p_ip", "p_ns", "p_name", "s_ip", "s_ns", "s_name")


def with_src(x: DataFrame, procs: DataFrame, cgroups: DataFrame, pods: DataFrame) -> DataFrame:
    """x(tgid, cgroup_id) with src: the pod of the process or of its cgroup by name, else a short label."""
    p = dimension(one_each(procs.select("tgid", "comm", S.pod_uid(F.col("cgroup")).alias("own_uid"), S.container_id(F.col("cgroup")).alias("cid")), "tgid"))
    c = dimension(one_each(cgroups.select(F.col("inode").alias("cgroup_id"), F.col("pod_uid").alias("cg_uid")), "cgroup_id"))
    n = dimension(one_each(pods.select(F.col("uid").alias("uid"), F.concat("namespace", F.lit("/"), "name").alias("pod")), "uid"))
    known = x.join(p, "tgid", "left").join(c, "cgroup_id", "left").withColumn("uid", F.coalesce("own_uid", "cg_uid"))
    label = S.process_label(F.col("uid"), F.col("cid"), F.col("comm"), F.col("tgid"))
    return known.join(n, "uid", "left").withColumn("src", F.coalesce("pod", label)).drop("uid", "own_uid", "cg_uid", "cid", "comm", "pod")


def comm_of(rows: DataFrame, procs: DataFrame) -> DataFrame:
    """rows(tgid, pid) with comm, looked up by tgid and else by pid."""
    by = lambda key, name: dimension(one_each(procs.select(F.col("tgid").alias(key), F.nullif(F.col("comm"), F.lit("")).alias(name)), key))
    return rows.join(by("tgid", "c1"), "tgid", "left").join(by("pid", "c2"), "pid", "left").withColumn("comm", F.coalesce("c1", "c2", F.lit(""))).drop("c1", "c2")


def leaders(procs: DataFrame) -> DataFrame:
    """Thread-group leaders with a name."""
    return procs.where((F.col("pid") == F.col("tgid")) & (F.col("comm") != ""))


def is_ipv4(text: Column) -> Column:
    part = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.coalesce(text.rlike(rf"^{part}(\.{part}){{3}}$"), F.lit(False))


_META = "metadata struct<namespace:string,name:string,uid:string,deletionTimestamp:string>"
_POD = f"{_META}, spec struct<hostNetwork:boolean>, status struct<phase:string,podIP:string,podIPs:array<struct<ip:string>>>"
_SERVICE = f"{_META}, spec struct<clusterIP:string,clusterIPs:array<string>>"


def _items(pages: DataFrame, item: str) -> DataFrame:
    parsed = pages.select(F.from_json("value", f"items array<struct<{_struct(item)}>>, metadata struct<continue:string>").alias("j"))
    return parsed.where("j.items IS NOT NULL").select(F.explode("j.items").alias("i")).select("i.*")


def _struct(ddl: str) -> str:
    """Top-level `name type` fields as struct fields, `name:type`."""
    out, depth = [], 0
    for part in ddl.split(", "):
        if depth == 0:
            part = part.replace(" ", ":", 1)
        depth += part.count("<") - part.count(">")
        out.append(part)
    return ",".join(out)


def pod_table(pages: DataFrame) -> DataFrame:
    """uid, namespace, name of every pod of list pages (value: JSON text)."""
    return _items(pages, _POD).select("metadata.uid", "metadata.namespace", "metadata.name").where("uid IS NOT NULL")


def pod_ips(pages: DataFrame) -> DataFrame:
    """ip, namespace, name of running pods with their own network that aren't being deleted; IPv4 only."""
    pods = _items(pages, _POD).where("status.phase = 'Running' AND NOT coalesce(spec.hostNetwork, false) AND metadata.deletionTimestamp IS NULL")
    listed = F.coalesce(F.expr("transform(status.podIPs, p -> p.ip)"), F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.array("status.podIP"), listed))
    return pods.select(F.explode(every).alias("ip"), "metadata.namespace", "metadata.name").where(is_ipv4(F.col("ip")))


def service_ips(pages: DataFrame) -> DataFrame:
    """ip, namespace, name of services with a cluster address; IPv4 only."""
    listed = F.coalesce("spec.clusterIPs", F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.array("spec.clusterIP"), listed))
    return _items(pages, _SERVICE).select(F.explode(every).alias("ip"), "metadata.namespace", "metadata.name").where(is_ipv4(F.col("ip")))


def merge_lists(pods: DataFrame | None, services: DataFrame | None, before: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A refresh: without pods all is kept as it was; without services the services are."""
    if pods is None:
        return before
    return pods, before[1] if services is None else services
