"""Queries over every field of the decoders, requests and answers, with their types; and over rules that compare by type.

The SQL states what each field of a payload is from the numbers that the payload was made of, field by field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otspark.functions import codes
from otspark.operators import cleartext, decode, rules, typed
from otspark.plans.catalog import register
from otspark.plans.frame_queries import MODBUS, modbus_frames
from otspark.sources.answers import ANSWERS_SQL, answers
from otspark.sources.packets import PACKETS, WIRE_SQL, wire


def name_of(code: str, names: dict, other: str = "NULL") -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


_LINK = {"dl_direction": "'Master→Outstation'", "dl_primary": "true", "dl_function_code": "4", "transport_fin": "true", "transport_fir": "true", "transport_seq": "0", "app_sequence": "1", "app_confirm_required": "false", "dl_destination": "n % 1000"}
_TPKT = {"tpkt_version": "3", "cotp_length": "2", "cotp_pdu_type": "240", "cotp_pdu_type_name": "'Unknown COTP (0xF0)'", "s7_protocol_id": "50", "s7_pdu_reference": "n % 65536", "s7_data_length": "0", "s7_function_code": "c", "s7_function_name": name_of("c", codes.S7)}
_CIP = {"enip_length": "22", "session_handle": "n % 65536", "options": "0", "cpf_item_count": "2", "enip_command": "111", "enip_command_name": "'SendRRData'", "cip_service": "c", "cip_service_name": name_of("c", codes.ENIP)}

#: Every field of the wire view's payloads, by protocol; what is NULL is a field that the frame lacks.
REQUESTS = {
    "s7": _TPKT | {
        "tpkt_length": "25", "s7_pdu_type": "1", "s7_pdu_type_name": "'JOB (Request)'", "s7_param_length": "8",
        "item_count": "CASE WHEN c IN (4, 5) THEN 1 END", "pdu_size": "CASE WHEN c = 240 THEN 0 END", "control_action": "CASE c WHEN 40 THEN 'START' WHEN 41 THEN 'STOP' END", "download_action": "CASE c WHEN 26 THEN 'request' END",
    },
    "dnp3": _LINK | {"dl_length": "11", "dl_source": "3", "app_unsolicited": "false", "first_group": "60", "first_variation": "2"},
    "opcua": {"message_type": "'MSG'", "message_type_name": "'Message'", "chunk_type": "'F'", "message_size": "32", "secure_channel_id": "n % 65536", "service_id": "c", "service_name": name_of("c", codes.OPCUA)},
    "enip": _CIP | {"status": "0", "cip_is_response": "false"},
    "iec104": {
        "apdu_length": "14", "frame_type": "'I-frame'", "send_sequence": "n % 1000", "recv_sequence": "2", "asdu_type_id": "c", "asdu_type_name": name_of("c", codes.IEC104), "sq": "false", "num_objects": "1", "cause_of_transmission": "6",
        "cot_name": "'Activation'", "positive_negative": "'Positive'", "test_mode": "false", "originator_address": "0", "asdu_address": "1", "first_ioa": "10",
    },
    "bacnet": {"bvlc_function": "10", "bvlc_function_name": "'Original-Unicast-NPDU'", "bvlc_length": "10", "apdu_kind": "'confirmed-request'", "service_choice": "c"},
    "mqtt": {"mqtt_message_type": "3", "mqtt_flags": "0", "remaining_length": "7", "topic": "'t/' || (n % 10)"},
    "snmp": {"snmp_version": "1", "community_present": "true", "community_len": "4", "pdu_tag": "160 + c", "pdu_type_name": name_of("c", codes.SNMP)},
    "omron_fins": {"fins_icf": "128", "fins_mrc": "c // 256", "fins_src": "c % 256", "fins_command_word": "c"},
    "ge_srtp": {"srtp_sequence": "n % 65536", "srtp_service": "c", "srtp_flags": "0", "srtp_payload_length": "16"},
}


def _unit(length: int, **more: str) -> dict[str, str]:
    return {"transaction_id": "n % 65536", "protocol_id": "0", "length": str(length), "unit_id": "n % 247", "function_code_raw": "c"} | more


_ADDRESS, _WORD = "n % 1000", "n % 65536"
_IIN = "(n % 256 + 256 * (n % 64))"
_ERROR = "(CASE WHEN n % 2 = 0 THEN 0 ELSE 129 + n % 5 END)"
#: Every field of the answers view's payloads, by kind.
FIELDS = {
    "modbus_exception": _unit(3, function_code_raw="128 + c", exception_code="n % 4 + 1", exception_name=name_of("n % 4 + 1", codes.MODBUS_EXCEPTIONS)),
    "modbus_registers": _unit(7, byte_count="4", register_values=f"printf('%04X', {_WORD}) || '00FF'"),
    "modbus_write_many": _unit(11, starting_address=_ADDRESS, quantity="2", byte_count="4", register_values=f"printf('%04X', {_WORD}) || '00FF'"),
    "modbus_coil": _unit(6, coil_address=_ADDRESS, coil_value="CASE WHEN n % 3 = 0 THEN 65280 ELSE 0 END", coil_state="CASE WHEN n % 3 = 0 THEN 'ON' ELSE 'OFF' END"),
    "modbus_register": _unit(6, register_address=_ADDRESS, register_value=_WORD),
    "modbus_read_write": _unit(13, read_starting_address=_ADDRESS, read_quantity="3", write_starting_address="n % 900", write_quantity="1", write_byte_count="2"),
    "modbus_identity": _unit(5, mei_type="14", read_device_id_code="1", object_id="n % 7"),
    "modbus_diagnostics": _unit(6, sub_function="n % 5", diagnostic_data=_WORD),
    "s7_answer": _TPKT | {
        "tpkt_length": "21", "s7_pdu_type": "3", "s7_pdu_type_name": "'ACK_DATA (Data Response)'", "s7_param_length": "2", "s7_error_class": _ERROR, "s7_error_class_name": name_of(_ERROR, codes.S7_ERRORS, "printf('Unknown (0x%02X)', " + _ERROR + ")"),
        "s7_error_code": "n % 8", "item_count": "CASE WHEN c IN (4, 5) THEN 2 END",
    },
    "dnp3_answer": _LINK | {
        "dl_direction": "'Outstation→Master'", "dl_length": "13", "dl_source": "10", "app_unsolicited": "true", "iin": _IIN,
        "iin_flags": "coalesce(array_to_string([" + ", ".join(f"CASE WHEN {_IIN} & {mask} <> 0 THEN '{text}' END" for mask, text in codes.DNP3_IIN.items()) + "], ', '), '')", "first_group": "30", "first_variation": "2",
    },
    "opcua_error": {"message_type": "'ERR'", "message_type_name": "'Error'", "chunk_type": "'F'", "message_size": "16", "error_code": _WORD},
    "opcua_hello": {"message_type": "'HEL'", "message_type_name": "'Hello'", "chunk_type": "'F'", "message_size": "32", "protocol_version": _WORD, "receive_buffer_size": "65536", "send_buffer_size": "131072"},
    "enip_session": {"enip_command": "101", "enip_command_name": "'RegisterSession'", "enip_length": "4", "session_handle": _WORD, "status": "0", "options": "5"},
    "enip_answer": _CIP | {"status": "n % 2", "cip_is_response": "true", "cip_status": "n % 15", "cip_status_name": name_of("n % 15", codes.CIP_STATUS, "printf('Unknown (0x%02X)', n % 15)")},
    "iec104_s": {"apdu_length": "4", "frame_type": "'S-frame'", "recv_sequence": "n % 1000"},
    "iec104_u": {"apdu_length": "4", "frame_type": "'U-frame'", "u_function": "['STARTDT ACT', 'STARTDT CON', 'STOPDT ACT', 'STOPDT CON', 'TESTFR ACT', 'TESTFR CON'][n % 6 + 1]"},
    "bacnet_ack": {"bvlc_function": "10", "bvlc_function_name": "'Original-Unicast-NPDU'", "bvlc_length": "11", "apdu_kind": "'complex-ack'", "service_choice": "c"},
    "mqtt_other": {"mqtt_message_type": "c", "mqtt_flags": "0", "remaining_length": "2"},
    "snmp_answer": {"snmp_version": "0", "community_present": "true", "community_len": "4", "pdu_tag": "162", "pdu_type_name": "'Response'"},
    "fins_answer": {"fins_icf": "192", "fins_mrc": "1", "fins_src": "c % 256", "fins_command_word": "c"},
}


def _pairs(view: str, by: str, of: dict[str, dict[str, str]]) -> str:
    """The fields of a view, a row each, with their types."""
    kind = lambda x: f"CASE typeof({x}) WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'flag' ELSE 'number' END"
    one = lambda key, fields: f"SELECT packet_number, slug, unnest([{', '.join(f'''{{'name': '{n}', 'value': CAST({x} AS VARCHAR), 'type': {kind(x)}}}''' for n, x in fields.items())}]) AS f FROM {view} WHERE {by} = '{key}'"
    return f"SELECT packet_number, slug AS protocol_slug, f.name AS name, f.value AS value, f.type AS type FROM ({' UNION ALL '.join(one(k, v) for k, v in of.items())}) WHERE f.value IS NOT NULL"


def fields_of(frames: DataFrame) -> DataFrame:
    """The typed fields of frames, a row each: name, value as text, type."""
    every = frames.select("packet_number", "protocol_slug", F.explode(F.try_variant_get(typed.DATA, "$", "map<string,variant>")).alias("name", "_v"))
    kind = F.schema_of_variant("_v")
    return every.select("packet_number", "protocol_slug", "name", F.try_variant_get("_v", "$", "string").alias("value"), F.when(kind == "STRING", "text").when(kind == "BOOLEAN", "flag").otherwise("number").alias("type"))


@register("request_fields", f"WITH {WIRE_SQL} {_pairs('wire', 'slug', REQUESTS)}")
def request_fields(spark, sf_dir):
    """Every field of the requests of ten protocols."""
    return fields_of(decode.decode(wire(spark, sf_dir), typed=True))


@register("answer_fields", f"WITH {ANSWERS_SQL} {_pairs('answers', 'kind', FIELDS)}")
def answer_fields(spark, sf_dir):
    """Every field of responses, exceptions, errors, connection frames and the rarer Modbus requests."""
    return fields_of(decode.decode(answers(spark, sf_dir), typed=True))


#: Function code, message type and whether it is an exception, by kind.
FRAMES = {
    "modbus_exception": ("c", "'exception'", "true"), "modbus_registers": ("c", "'response'", "false"), **{f"modbus_{k}": ("c", "'request'", "false") for k in ("write_many", "coil", "register", "read_write", "identity", "diagnostics")},
    "s7_answer": ("c", "'ACK_DATA (Data Response)'", f"{_ERROR} <> 0"), "dnp3_answer": ("c", "'response'", "false"), "opcua_error": ("NULL", "'ERR'", "true"), "opcua_hello": ("NULL", "'HEL'", "false"),
    "enip_session": ("NULL", "'RegisterSession'", "false"), "enip_answer": ("c", "'SendRRData'", "n % 2 = 1"), "iec104_s": ("NULL", "'S-frame'", "false"), "iec104_u": ("NULL", "'U-frame'", "false"),
    "bacnet_ack": ("c", name_of("c", codes.BACNET), "false"), "mqtt_other": ("c", name_of("c", codes.MQTT), "false"), "snmp_answer": ("2", "'Response'", "false"), "fins_answer": ("c", name_of("c", codes.FINS), "false"),
}
#: Kinds whose frames say themselves whether they ask, whichever way they go; the others go by the port.
ASKS = {"bacnet_ack": "true", "mqtt_other": "false", "iec104_u": "true"}


@register(
    "answer_frames",
    f"WITH {ANSWERS_SQL} SELECT packet_number, slug AS protocol_slug, "
    + ", ".join(f"CASE kind {' '.join(f'WHEN {k!r} THEN {v[i]}' for k, v in FRAMES.items())} END AS {name}" for i, name in enumerate(("function_code", "message_type", "is_exception")))
    + f", CASE kind {' '.join(f'WHEN {k!r} THEN {v}' for k, v in ASKS.items())} ELSE asks END AS is_request FROM answers",
)
def answer_frames(spark, sf_dir):
    """What the frames of the answers view are: code, kind of message, exception, request."""
    return decode.decode(answers(spark, sf_dir)).select("packet_number", "protocol_slug", "function_code", "message_type", "is_exception", "is_request")


#: Rules whose clauses compare fields: as numbers, as flags, as texts.
BY_TYPE = [
    rules.Rule("T-1", "many registers", "LOW", "PROTOCOL", {"protocol": "modbus", "payload_field": {"name": "quantity", "greater_than": 99.5, "less_than": 120}}),
    rules.Rule("T-2", "broadcast", "HIGH", "PROTOCOL", {"protocol": "modbus", "payload_field": {"name": "unit_id", "equals": 255}}),
    rules.Rule("T-3", "a number is no text", "HIGH", "PROTOCOL", {"protocol": "modbus", "payload_field": {"name": "unit_id", "equals": "255"}}),
    rules.Rule("T-4", "coil on", "MEDIUM", "PROTOCOL", {"protocol": "modbus", "function_code": 5, "payload_field": {"name": "coil_state", "equals": "ON"}}),
    rules.Rule("T-5", "no address", "LOW", "PROTOCOL", {"protocol": "modbus", "payload_field": {"name": "transaction_id", "equals": None}}),
    rules.Rule("T-6", "register above ninety, code of nine", "LOW", "PROTOCOL", {"payload_field": {"name": "register_address", "greater_than": 9}, "function_code": {"range": [6, 15]}}),
]


@register(
    "rules_by_type",
    f"WITH {PACKETS}, {MODBUS} SELECT packet_number, rule_id FROM (SELECT packet_number, unnest([CASE WHEN fc IN (1, 2, 3, 4) AND dst_port = 502 AND qty > 99 AND qty < 120 THEN 'T-1' END, CASE WHEN unit = 255 THEN 'T-2' END, CASE WHEN fc = 6 AND addr > 9 THEN 'T-6' END]) AS rule_id FROM modbus) WHERE rule_id IS NOT NULL",
)
def rules_by_type(spark, sf_dir):
    """Rules over typed fields: 9 is less than 10 and 255 is no text."""
    return rules.events(modbus_frames(spark, sf_dir, typed=True), BY_TYPE).select("packet_number", "rule_id")


@register(
    "cleartext_protocols",
    f"WITH {WIRE_SQL}, {ANSWERS_SQL[len(PACKETS) + 2 :]}, seen AS ("
    "SELECT packet_number, 'request' AS way, slug AS of FROM wire WHERE slug IN ('s7', 'dnp3', 'bacnet') UNION ALL SELECT packet_number, 'answer', CASE kind WHEN 'opcua_hello' THEN 'opcua' WHEN 'enip_session' THEN 'enip' ELSE slug END FROM answers WHERE kind IN ('s7_answer', 'dnp3_answer', 'bacnet_ack', 'opcua_hello', 'enip_session')) "
    "SELECT packet_number, way, CASE of WHEN 's7' THEN 's7comm_cleartext' WHEN 'dnp3' THEN 'dnp3_cleartext' WHEN 'bacnet' THEN 'bacnet_ip_cleartext' WHEN 'opcua' THEN 'opcua_cleartext' ELSE 'enip_cleartext' END AS category, CASE WHEN of IN ('s7', 'dnp3') THEN 'HIGH' ELSE 'MEDIUM' END AS sensitivity FROM seen",
)
def cleartext_protocols(spark, sf_dir):
    """Readable frames of S7, DNP3, OPC UA, EtherNet/IP and BACnet, asked and answered."""
    shown = ("s7comm_cleartext", "dnp3_cleartext", "opcua_cleartext", "enip_cleartext", "bacnet_ip_cleartext")
    both = wire(spark, sf_dir).withColumn("way", F.lit("request")).unionByName(answers(spark, sf_dir).withColumn("way", F.lit("answer")))
    return cleartext.observations(both).where(F.col("category").isin(*shown)).select("packet_number", "way", "category", "sensitivity")
