"""Column schemas of the release tables, task keys and values (fixed values of the data format)."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = {
    "state": ["panel", "timestamp", "station_id", "link_id", "mask_regime"],
    "queue": ["window_id", "timestamp", "link_id"],
    "odme": ["panel", "departure_time", "path_id", "origin_zone", "destination_zone"],
}
VALUES = {"state": ["speed_kmh", "flow_vph"], "queue": ["queue_pred"], "odme": ["path_flow"]}
MASK_REGIMES = ("R1", "R2", "R3")
SPLITS = ("train", "validation", "private")
KINDS = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "t": T.TimestampType()}

#: name: columns as "name:kind", in file order; kinds are string, double, long and timestamp.
_TABLES = {
    "links": "link_id:s length_km:d lanes:d free_speed_kmh:d capacity_vph:d",
    "fd_parameters": "link_id:s length_km:d lanes:d free_speed_kmh:d capacity_vph:d critical_density:d k_jam:d",
    "path_set": "path_id:s origin_zone:s destination_zone:s link_seq:s",
    "path_link_incidence": "link_id:s path_id:s",
    "lwr_mainline_topology": "mainline_link_id:s incoming_link_ids:s outgoing_link_ids:s on_ramp_link_ids:s off_ramp_link_ids:s incoming_has_sensor:s outgoing_has_sensor:s lanes:l length_km:d capacity_vph:d free_speed_kmh:d order_index:l link_id:s from_node:l to_node:l has_sensor:l detector_id:s n_incoming:l n_outgoing:l n_incoming_no_sensor:l n_outgoing_no_sensor:l free_flow_speed_kmh:d",
    "ramp_attachment_map": "ramp_link_id:s ramp_type:s nearest_mainline_link_id:s",
    "synthetic_ramp_attachment_map": "ramp_link_id:s ramp_type:s nearest_mainline_link_id:s",
    "mainline_states": "corridor_id:s date:s timestamp:t station_id:s link_id:s milepost:d direction:s speed_kmh:d flow_vph:d occupancy:d density_occ_linear_vehpkm:d pct_observed:l is_observed:l is_imputed:l is_score_eligible:l is_missing:l",
    "ramp_states": "corridor_id:s date:s timestamp:t station_id:s ramp_link_id:s ramp_type:s flow_vph:d pct_observed:l is_observed:l is_imputed:l is_score_eligible:l is_missing:l",
    "queue_history": "window_id:s timestamp:t link_id:s speed_kmh:d flow_vph:d occupancy:d pct_observed:l is_score_eligible:l",
    "queue_window_index": "window_id:s panel:s family_id:s split:s date:s forecast_origin:t history_start:t history_end:t forecast_start:t forecast_end:t condition:s history_coverage:d future_coverage:d",
    "state_targets": "panel:s timestamp:t station_id:s link_id:s mask_regime:s speed_kmh:d flow_vph:d",
    "queue_targets": "window_id:s timestamp:t link_id:s queue_pred:l",
    "odme_targets": "panel:s departure_time:s path_id:s origin_zone:s destination_zone:s path_flow:d",
    "weak_prior": "panel:s departure_time:s path_id:s origin_zone:s destination_zone:s path_flow:d",
    "link_counts": "panel:s link_id:s count:d",
    "submission_key": "submission_id:s task:s split:s panel:s timestamp:s station_id:s link_id:s mask_regime:s window_id:s departure_time:s path_id:s origin_zone:s destination_zone:s",
    "submission": "submission_id:s task:s speed_kmh:d flow_vph:d queue_pred:d path_flow:d",
}


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (c.split(":") for c in spec.split())])


SCHEMAS = {name: _struct(spec) for name, spec in _TABLES.items()}
SCHEMAS["mainline_states_masked"] = T.StructType([*SCHEMAS["mainline_states"].fields, T.StructField("mask_regime", T.StringType())])
NETWORK_TABLES = ("links", "fd_parameters", "path_set", "path_link_incidence", "lwr_mainline_topology", "ramp_attachment_map", "synthetic_ramp_attachment_map")
