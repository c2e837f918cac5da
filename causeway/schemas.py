"""Fixed schemas: the event record on the wire and the stored tables."""

from __future__ import annotations

FACETS = "map<string,string>"

DATASET = (
    f"struct<namespace:string,name:string,facets:{FACETS},inputFacets:{FACETS},outputFacets:{FACETS}>"
)

# One run event as tools send it. The time stays text until it is parsed leniently.
WIRE_EVENT = (
    "eventTime string, eventType string, producer string, schemaURL string, "
    f"run struct<runId:string,facets:{FACETS}>, "
    f"job struct<namespace:string,name:string,facets:{FACETS}>, "
    f"inputs array<{DATASET}>, outputs array<{DATASET}>"
)

# The same as one struct type, for from_json.
WIRE_EVENT_TYPE = (
    "struct<eventTime:string,eventType:string,producer:string,schemaURL:string,"
    f"run:struct<runId:string,facets:{FACETS}>,"
    f"job:struct<namespace:string,name:string,facets:{FACETS}>,"
    f"inputs:array<{DATASET}>,outputs:array<{DATASET}>>"
)

# Its single fields alone; facets and datasets are passed over.
WIRE_HEAD_TYPE = (
    "struct<eventTime:string,eventType:string,producer:string,schemaURL:string,"
    "run:struct<runId:string>,job:struct<namespace:string,name:string>>"
)

# Columns of one received message: ``arrival`` orders messages, ``batch_id`` groups one request.
ENVELOPE = "batch_id bigint, arrival bigint, ingested_at timestamp, value string"

STORED_DATASET = (
    f"struct<namespace:string,name:string,urn:string,facets:{FACETS},"
    f"input_facets:{FACETS},output_facets:{FACETS}>"
)

SEED_CUSTOMERS = "id string, name string"
SEED_ORDERS = (
    "id string, customer string, ordered_at timestamp, store_id string, "
    "subtotal bigint, tax_paid bigint, order_total bigint"
)
