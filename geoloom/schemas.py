"""Message and table schemas, with the fields a record must have to be accepted."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, LONG, DOUBLE, BOOL, STAMP = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType())
BYTES = T.ArrayType(T.ByteType())
STRINGS = T.ArrayType(STRING)

BOUNDS = _struct(minX=DOUBLE, maxX=DOUBLE, minY=DOUBLE, maxY=DOUBLE)
SERVER = _struct(host=STRING, port=LONG, localPath=STRING)
TASK = _struct(service=STRING, parameters=STRINGS)

DEPLOY_STATUS = _struct(status=STRING, id=LONG, server=SERVER)
JOB_STATUS = _struct(
    status=STRING, id=STRING, serviceName=STRING, params=STRINGS, node=STRING, progress=DOUBLE,
    result=STRING, reason=STRING, task=TASK)

# Wire schema per message type. Tagged unions are one wide struct plus the tag column.
MESSAGES: dict[str, T.StructType] = {
    "upload": _struct(name=STRING, locator=STRING),
    "metadata": _struct(name=STRING, locator=STRING, checksum=BYTES, size=LONG),
    "geometadata": _struct(locator=STRING, crsCode=STRING, nativeBoundingBox=BOUNDS,
                           latitudeLongitudeBoundingBox=BOUNDS, nativeFormat=STRING),
    "bounds": BOUNDS,
    "server": SERVER,
    "lease": _struct(id=LONG, deployment=LONG, lifetime=STRING, tag=BYTES),
    "request_lease": _struct(locator=STRING, timeout=LONG, tag=BYTES),
    "lease_granted": _struct(locator=STRING, timeout=LONG, tag=BYTES),
    "request_deploy": _struct(locator=STRING, deployId=LONG, server=SERVER),
    "request_simplify": _struct(locator=STRING, tolerance=DOUBLE),
    "deploy_status": DEPLOY_STATUS,
    "job_status": JOB_STATUS,
    "job_request": _struct(type=STRING, tag=STRING, id=STRING, service=STRING, parameters=STRINGS,
                           status=JOB_STATUS),
}

# Fields that may be absent. Everything else named in the schema is required.
OPTIONAL: dict[str, set[str]] = {"lease": {"lifetime"}}

# Required fields per tag value, for the tagged unions.
TAGGED: dict[str, dict[str, list[str]]] = {
    "deploy_status": {
        "starting": ["id"],
        "live": ["id", "server.host", "server.port", "server.localPath"],
        "dead": [],
    },
    "job_status": {
        "pending": ["id", "serviceName", "params"],
        "assigned": ["id", "node"],
        "started": ["id", "node"],
        "progress": ["id", "progress"],
        "done": ["id", "result"],
        "failed": ["id", "reason"],
        "aborted": ["id"],
    },
    "job_request": {
        "submit": ["id", "service", "parameters"],
        "report": ["status.status", "status.id"],
    },
}

# Topic -> message types to try, in order.
TOPICS: dict[str, list[str]] = {
    "uploads": ["upload"],
    "metadata": ["metadata", "geometadata"],
    "lease-requests": ["request_lease"],
    "lease-grants": ["lease_granted"],
    "deploy-requests": ["request_deploy"],
    "simplify-requests": ["request_simplify"],
    "job-request": ["job_request"],
    "job-status": ["job_status"],
    "simplify-job-request": ["job_request"],
    "simplify-job-status": ["job_status"],
}

DEPLOYMENT_STATES = ["starting", "live", "killing", "dead"]

METADATA_TABLE = _struct(id=LONG, locator=STRING, name=STRING, checksum=STRING, size=LONG)
GEOMETADATA_TABLE = _struct(id=LONG, locator=STRING, native_srid=STRING, native_format=STRING,
                            native_bounds=BOUNDS, latlon_bounds=BOUNDS)
SERVERS_TABLE = _struct(id=LONG, host=STRING, port=LONG, local_path=STRING, response_time=LONG)
DEPLOYMENTS_TABLE = _struct(id=LONG, locator=STRING, server=LONG, state=STRING)
LEASES_TABLE = _struct(id=LONG, locator=STRING, deployment=LONG, lifetime=STAMP, tag=STRING)

VERTEX = _struct(x=DOUBLE, y=DOUBLE)
# parts: one entry per member geometry, each a list of rings or lines, each a list of vertices.
GEOMETRY = _struct(kind=STRING, parts=T.ArrayType(T.ArrayType(T.ArrayType(VERTEX))), srid=LONG)


def required_fields(message: str) -> list[str]:
    """Dotted names of the leaf fields an untagged message must carry."""
    skip = OPTIONAL.get(message, set())

    def walk(struct: T.StructType, prefix: str) -> list[str]:
        names: list[str] = []
        for field in struct.fields:
            if prefix == "" and field.name in skip:
                continue
            path = prefix + field.name
            if isinstance(field.dataType, T.StructType):
                names += walk(field.dataType, path + ".")
            else:
                names.append(path)
        return names

    return walk(MESSAGES[message], "")
