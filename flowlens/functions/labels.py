"""Code -> label expressions and per-protocol summary text.

Label maps are small literal CASE expressions (inlined into codegen), not joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ICMP / ICMPv6 type names
ICMP_TYPES = {0: "Echo Reply", 4: "Source Quench", 5: "Redirect", 8: "Echo Request",
              12: "Parameter Problem", 128: "Echo Request (v6)", 129: "Echo Reply (v6)",
              133: "Router Solicitation", 134: "Router Advertisement",
              135: "Neighbor Solicitation", 136: "Neighbor Advertisement"}
ICMP_UNREACHABLE = {0: "Destination Unreachable (Net)", 1: "Destination Unreachable (Host)",
                    2: "Destination Unreachable (Protocol)", 3: "Destination Unreachable (Port)"}
ICMP_TIME_EXCEEDED = {0: "TTL Exceeded in Transit", 1: "Fragment Reassembly Time Exceeded"}
# fixed values: DNS query types and response codes
DNS_QTYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT",
              28: "AAAA", 33: "SRV", 255: "ANY"}
DNS_RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP",
              5: "REFUSED"}
# fixed values: IP protocol numbers (cloud flow logs)
IP_PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMPv6", 47: "GRE", 50: "ESP"}
# fixed values: port sets of the agent's protocol heuristics
TLS_PORTS = [443, 8443, 465, 587, 636, 993, 995, 5061, 8883]
HTTP_PORTS = [80, 8080, 3000]
HTTPS_PORTS = [443, 8443, 4433]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _case(key: Column, mapping: dict, default: Column) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v)))
    return out.otherwise(default)


def icmp_type_name(icmp_type, icmp_code) -> Column:
    t, c = _c(icmp_type), _c(icmp_code)
    generic = F.format_string("ICMP type %d code %d", t, c)
    unreach = _case(c, ICMP_UNREACHABLE, F.format_string("Destination Unreachable (code %d)", c))
    exceeded = _case(c, ICMP_TIME_EXCEEDED, F.format_string("Time Exceeded (code %d)", c))
    return F.when(t == 3, unreach).when(t == 11, exceeded).otherwise(_case(t, ICMP_TYPES, generic))


def dns_qtype_name(qtype) -> Column:
    return _case(_c(qtype), DNS_QTYPES, F.lit("UNKNOWN"))


def dns_rcode_name(rcode) -> Column:
    return _case(_c(rcode), DNS_RCODES, F.lit("UNKNOWN"))


def ip_proto_name(num) -> Column:
    n = _c(num)
    names = F.create_map(*[x for k, v in IP_PROTOCOLS.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    return F.coalesce(F.try_element_at(names, n.cast("bigint")), F.format_string("PROTO_%d", n))


def classify_protocol(protocol, src_port, dst_port) -> Column:
    """Port heuristic of the agent: TLS ports (either side) -> TLS, HTTP ports -> HTTP."""
    s, d = _c(src_port), _c(dst_port)
    return (F.when(s.isin(TLS_PORTS) | d.isin(TLS_PORTS), F.lit("TLS"))
            .when(s.isin(HTTP_PORTS) | d.isin(HTTP_PORTS), F.lit("HTTP"))
            .otherwise(_c(protocol)))


def grpc_target(http) -> tuple[Column, Column]:
    """(service, method) of a call whose content type is application/grpc; else null."""
    h = _c(http)
    is_grpc = F.exists(h["headers"], lambda x: (F.lower(x["name"]) == "content-type")
                       & F.lower(x["value"]).startswith("application/grpc"))
    part = F.split(h["path"], "/")
    ok = is_grpc & (F.size(part) == 3)
    return F.when(ok, F.get(part, 1)), F.when(ok, F.get(part, 2))


def flow_info(protocol="protocol", http="http", dns="dns", tls="tls", icmp="icmp",
              arp="arp", grpc_service=None, grpc_method=None) -> Column:
    """Summary text of a nested wire flow, by payload kind."""
    h, d, t, i, a = _c(http), _c(dns), _c(tls), _c(icmp), _c(arp)
    rt = t["record_type"]
    tls_txt = (F.when(rt == "ClientHello",
                      F.concat(F.lit("ClientHello"), F.coalesce(F.concat(F.lit(" → "), t["sni"]), F.lit(""))))
               .when(rt == "ServerHello",
                     F.concat(F.lit("ServerHello "), F.coalesce(t["chosen_cipher"], F.lit("?"))))
               .when(rt == "Certificate",
                     F.concat(F.lit("Certificate "), F.coalesce(t["cert_cn"], F.lit("?")),
                              F.when(F.coalesce(t["cert_expired"], F.lit(False)), F.lit(" [EXPIRED]"))
                              .otherwise(F.lit(""))))
               .when(rt == "Alert",
                     F.concat(F.lit("Alert "), F.coalesce(t["alert_level"], F.lit("")), F.lit(" "),
                              F.coalesce(t["alert_description"], F.lit(""))))
               .otherwise(rt))
    icmp_txt = F.when(i["rtt_ms"].isNotNull(),
                      F.format_string("%s (%.1fms)", i["type_str"], i["rtt_ms"])).otherwise(i["type_str"])
    http_txt = F.concat_ws(" ", F.coalesce(h["method"], F.lit("")), F.coalesce(h["path"], F.lit("")))
    if grpc_service is not None and grpc_method is not None:
        g = F.when(_c(grpc_service).isNotNull() & _c(grpc_method).isNotNull(),
                   F.concat(F.lit("gRPC "), _c(grpc_service), F.lit("/"), _c(grpc_method)))
        http_txt = F.coalesce(g, http_txt)
    return (F.when(h.isNotNull(), http_txt)
            .when(d.isNotNull(), F.concat_ws(" ", d["query_name"], d["query_type"]))
            .when(t.isNotNull(), tls_txt)
            .when(i.isNotNull(), icmp_txt)
            .when(a.isNotNull(), F.concat(a["operation"], F.lit(" "), a["sender_ip"], F.lit(" → "),
                                          a["target_ip"]))
            .otherwise(F.lit("")))
