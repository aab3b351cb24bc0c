"""Table schemas as DDL."""

from cidrloom.functions.patterns import DEVICE_TYPE

HOP = (
    "struct<hop:int,ip:string,rtt_avg:double,rtt_best:double,rtt_worst:double,icmp_type:int,"
    f"asn:bigint,ptr:string,device:{DEVICE_TYPE}>"
)
ROUTE = f"struct<version:string,measured_at:string,source:string,destination:string,stop_reason:string,hops:array<{HOP}>>"
TRACE_LINE = f"range string, routes {ROUTE}"

WHOIS = (
    "struct<inetnum:string,netname:string,descr:string,country:string,source:string,last_modified:string,"
    "as_num:string,as_name:string,as_descr:string>"
)
WHOIS_LINE = f"network string, whois {WHOIS}"

GATEWAY = f"struct<ip:string,ptr:string,votes:bigint,total:bigint,status:string,device:{DEVICE_TYPE}>"
GATEWAY_LINE = (
    "range string, netname string, descr string, as_num string, as_name string, as_descr string, inetnum string, "
    f"country string, whois_source string, whois_last_modified string, gateway {GATEWAY}, routes array<{HOP}>, "
    "measured_at string, xlsx map<string,variant>, xlsx_matched struct<backbone:boolean,hosting:boolean>, gateway_found boolean"
)

PROBE = "struct<addr:string,probe_ttl:bigint,rtt:double,icmp_type:int>"
TRACE_DOC = (
    "version string, type string, src string, dst string, stop_reason string, "
    f"start struct<sec:bigint,usec:bigint>, hops array<{PROBE}>"
)

REGISTRY_RECORDS = "data struct<records:array<array<struct<key:string,value:string>>>>"
REGISTRY_PREFIXES = "data struct<prefixes:array<struct<prefix:string>>>"
REGISTRY_ASNS = "data struct<asns:array<bigint>>"

CELL = "struct<kind:string,s:string,i:bigint,f:double,b:boolean>"
"""Kinds of a sheet cell: string | int | float | bool | empty | other."""
