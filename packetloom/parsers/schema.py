"""Structs of parsed sessions as DDL."""

from __future__ import annotations

TLS = """struct<
client_hello: struct<version: int, random: binary, session_id: binary, cipher_suites: array<int>, compression_algs: array<int>, extension_list: array<int>, server_name: string,
  supported_groups: array<int>, ec_point_formats: array<int>, alpn_protocols: array<string>, signature_algs: array<int>, key_shares: array<struct<group: int, kx_data: binary>>, supported_versions: array<int>>,
server_hello: struct<version: int, random: binary, session_id: binary, cipher_suite: int, compression_alg: int, extension_list: array<int>, ec_point_formats: array<int>, alpn_protocol: string,
  key_share: struct<group: int, kx_data: binary>, selected_version: int>,
server_certificates: array<binary>, client_certificates: array<binary>, server_key_exchange: binary, client_key_exchange: binary>"""
HTTP = """struct<
request: struct<method: string, uri: string, version: string, user_agent: string, cookie: string, host: string, content_length: bigint, content_type: string, transfer_encoding: string>,
response: struct<version: string, status_code: int, status_msg: string, content_length: bigint, content_type: string, transfer_encoding: string>, trans_depth: int>"""
_RECORD = "array<struct<name: string, kind: string, rdata: string, ttl: bigint>>"
DNS = f"""struct<transaction_id: int, query: struct<num_questions: int, recursion_desired: boolean, queries: array<string>>,
response: struct<response_code: string, authoritative: boolean, recursion_available: boolean, num_answers: int, num_additional: int, num_nameservers: int, answers: {_RECORD}, nameservers: {_RECORD}, additionals: {_RECORD}>>"""
_VERSION = "struct<protoversion: string, softwareversion: string, comments: string>"
SSH = f"""struct<client_version_exchange: {_VERSION}, server_version_exchange: {_VERSION},
key_exchange: struct<cookie: binary, kex_algs: array<string>, server_host_key_algs: array<string>, encryption_algs_client_to_server: array<string>, encryption_algs_server_to_client: array<string>,
  mac_algs_client_to_server: array<string>, mac_algs_server_to_client: array<string>, compression_algs_client_to_server: array<string>, compression_algs_server_to_client: array<string>,
  languages_client_to_server: array<string>, languages_server_to_client: array<string>, first_kex_packet_follows: boolean>,
client_dh: binary, server_dh: struct<host_key: binary, f: binary, signature: binary>, client_new_keys: boolean, server_new_keys: boolean>"""
QUIC = f"""struct<packets: array<struct<header_type: string, packet_type: string, version: bigint, dcid: string, scid: string, token: binary, retry_tag: binary, payload_bytes_count: int, frames: array<string>>>,
cids: array<string>, tls: {TLS}>"""
#: Columns of a session row besides those of its connection.
SESSION = f"session_no int, protocol string, tls {TLS}, http {HTTP}, dns {DNS}, ssh {SSH}, quic {QUIC}".replace("\n", " ")
