"""Ports, vendor prefixes, component catalog, and code sets of industrial protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: port, slug, service, transport, is_ics, risk
PORTS = [
    (502, "modbus", "Modbus TCP", "tcp", True, "elevated"),
    (102, "s7", "Siemens S7 (COTP/TPKT)", "tcp", True, "elevated"),
    (20000, "dnp3", "DNP3", "both", True, "elevated"),
    (4840, "opcua", "OPC UA Binary", "tcp", True, "elevated"),
    (44818, "enip", "EtherNet/IP (TCP)", "tcp", True, "elevated"),
    (2222, "enip", "EtherNet/IP (UDP)", "udp", True, "elevated"),
    (2404, "iec104", "IEC 60870-5-104", "tcp", True, "elevated"),
    (47808, "bacnet", "BACnet/IP", "udp", True, "normal"),
    (9600, "omron_fins", "Omron FINS", "both", True, "elevated"),
    (18245, "ge_srtp", "GE SRTP", "tcp", True, "elevated"),
    (18246, "ge_srtp", "GE SRTP (alt)", "tcp", True, "elevated"),
    (1089, "ff_hsb", "Foundation Fieldbus HSE", "tcp", True, "normal"),
    (34962, "profinet", "PROFINET RT", "udp", True, "elevated"),
    (34963, "profinet", "PROFINET RT-DCP", "udp", True, "elevated"),
    (34964, "profinet", "PROFINET Context Manager", "tcp", True, "elevated"),
    (22, "ssh", "SSH", "tcp", False, "normal"),
    (23, "telnet", "Telnet", "tcp", False, "critical"),
    (80, "http", "HTTP", "tcp", False, "normal"),
    (443, "https", "HTTPS", "tcp", False, "normal"),
    (161, "snmp", "SNMP", "udp", False, "normal"),
    (3389, "rdp", "RDP", "tcp", False, "elevated"),
    (5900, "vnc", "VNC", "tcp", False, "elevated"),
    (1433, "mssql", "MS SQL Server", "tcp", False, "elevated"),
    (3306, "mysql", "MySQL", "tcp", False, "elevated"),
]

# fixed values: first three octets of a MAC address and the vendor
VENDORS = [
    ("00:0E:8C", "Siemens AG"),
    ("00:1B:1B", "Siemens AG"),
    ("00:1C:06", "Siemens AG"),
    ("00:50:56", "VMware (virtual)"),
    ("08:00:06", "Siemens AG"),
    ("A8:F7:E0", "Siemens AG"),
    ("64:9F:F7", "Siemens AG"),
    ("00:00:54", "Schneider Electric"),
    ("00:80:F4", "Schneider Electric (Modicon)"),
    ("00:20:D5", "Schneider Electric"),
    ("00:00:BC", "Rockwell Automation (Allen-Bradley)"),
    ("00:01:01", "Rockwell Automation"),
    ("00:1D:9C", "Rockwell Automation"),
    ("00:02:99", "ABB"),
    ("00:21:99", "ABB"),
    ("00:24:2B", "ABB"),
    ("00:40:84", "Honeywell"),
    ("00:D0:2B", "Honeywell"),
    ("00:11:57", "Emerson Process Management"),
    ("00:A0:68", "Emerson Electric"),
    ("00:04:A5", "GE Intelligent Platforms"),
    ("00:60:E9", "GE Fanuc Automation"),
    ("00:01:E5", "Yokogawa Electric"),
    ("00:A0:6E", "Yokogawa Electric"),
    ("00:A0:45", "Phoenix Contact"),
    ("EC:E5:13", "Phoenix Contact"),
    ("00:01:05", "Beckhoff Automation"),
    ("00:30:DE", "Wago Kontakttechnik"),
    ("00:90:E8", "Moxa Technologies"),
    ("00:80:63", "Hirschmann Automation"),
    ("00:1A:A1", "Cisco Systems"),
    ("00:17:94", "Cisco Systems"),
    ("00:1B:54", "Cisco Systems"),
    ("00:1A:4B", "Hewlett-Packard"),
    ("3C:D9:2B", "Hewlett-Packard"),
    ("00:0C:29", "VMware (virtual)"),
    ("00:15:5D", "Microsoft Hyper-V"),
    ("08:00:27", "Oracle VirtualBox"),
    ("52:54:00", "QEMU/KVM"),
]

# fixed values: default ports of each protocol
DEFAULT_PORTS = {
    "modbus": [502], "s7": [102], "dnp3": [20000], "opcua": [4840], "enip": [44818, 2222], "iec104": [2404],
    "bacnet": [47808], "mqtt": [1883, 8883, 8884, 9001], "snmp": [161, 162], "omron_fins": [9600], "ge_srtp": [18245, 18246],
}
#: Protocols that are also recognised by their payload.
HEURISTIC = ("modbus", "s7", "dnp3", "opcua", "enip", "iec104", "bacnet", "omron_fins")
NAMES = {"modbus": "Modbus", "s7": "S7", "dnp3": "DNP3", "opcua": "OPC UA", "enip": "EtherNet/IP", "iec104": "IEC 104", "bacnet": "BACnet", "mqtt": "MQTT", "snmp": "SNMP", "omron_fins": "Omron FINS", "ge_srtp": "GE SRTP"}

# fixed values: three sets of "industrial" protocol names, each with its own use
ROLE_PROTOCOLS = ("Modbus", "S7", "DNP3", "OPC UA", "EtherNet/IP", "IEC 104", "BACnet", "MQTT", "SNMP")
OT_PROTOCOLS = ("Modbus", "S7", "DNP3", "OPC UA", "IEC 104", "BACnet", "EtherNet/IP", "GE SRTP", "Omron FINS", "MQTT")
OT_ROLES = ("PLC", "HMI", "HISTORIAN", "ENG_STATION", "RTU", "GATEWAY", "SCADA_SERVER", "IO_MODULE")

# fixed values: ports of remote administration, of enumeration, of risky services
IT_EDGE = {445: "SMB", 139: "NetBIOS/SMB", 135: "MS-RPC", 3389: "RDP", 22: "SSH", 5985: "WinRM", 5986: "WinRM-SSL", 23: "Telnet", 21: "FTP-control"}
ICS_APP_PORTS = (502, 102, 2404, 20000, 4840, 44818, 47808, 9600, 18245, 18246)
RISKY_PORTS = (23, 21, 5900, 3389)
BASELINE_ICS = {502: "modbus", 102: "s7", 20000: "dnp3"}
BASELINE_IT = {22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http", 135: "msrpc", 139: "netbios_ssn", 443: "https", 445: "smb", 3389: "rdp", 5900: "vnc", 5985: "winrm_http", 5986: "winrm_https"}
ENGINEERING_ROLES = ("ENG_STATION", "HMI", "SCADA_SERVER", "GATEWAY")

# fixed values: severities by rank, and their scores
SEVERITIES = {"INFO": 1, "LOW": 2, "MEDIUM": 3, "HIGH": 4, "CRITICAL": 5}
SCORES = {"CRITICAL": 10, "HIGH": 8, "MEDIUM": 5, "LOW": 3, "INFO": 1}

# fixed values: Modbus function codes that write, by use
MODBUS_WRITES = (5, 6, 15, 16, 21, 22, 23)
CLEARTEXT_WRITES = (5, 6, 15, 16, 22, 23)
BASELINE_WRITES = (5, 6, 15, 16, 22, 24)
CRITICAL_WRITES = (5, 6, 15, 16)


def ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PORTS, "port int, slug string, service string, transport string, is_ics boolean, risk string")


def vendors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VENDORS, "prefix string, vendor string")


def values(rows: list[tuple]) -> str:
    """The rows as the body of a SQL VALUES list."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
