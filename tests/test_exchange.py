"""The exchange folder as files on disk: what is loaded, what is set aside and why."""

import pytest

from ledgerloom.sources import exchange

PLAIN = {
    "accountnumber": "account_number,mule,fraud,victim,is_external\na1,1,0,0,0\na2,0,1,,0\na3,x,0,0,y\n,1,1,1,1\na4,1,0\n",
    "external_accounts": "account_id,kind,category\nx1,bank,fin\na2,wallet,\n",
    "merchants": "counterparty_acct,category\nm1,shop\nx1,zoo\n",
    "person": "customer_id,mule,fraud,victim\np1,0,0,1\np2,1,0,0\n",
    "device": "device_id,device_type,flagged_device\nd1,phone,True\nd2,laptop,False\nd3,tv,true\n",
    "ipaddress": "ip_address,blacklisted_ip\ni1,True\ni2,\n",
    "HAS_USED": "FROM,TO,first_seen,last_seen\np1,d1,2025-01-02 00:00:00,2025-01-03 00:00:00\np1,d1,2025-01-01 00:00:00,2025-01-02 00:00:00\np2,d2,soon,2025-01-01 00:00:00\n",
    "HAS_IP": "FROM,TO,first_seen,last_seen\np1,i1,,\np9,i9,,\n",
    "HAS_ACCOUNT": "FROM,TO\np1,a1\np1,a1\np1,x1\n,a1\np2,\np2,nowhere\n",
    "ACCOUNT_FLOW_AGG": "from_id,to_id,total_amount,txn_count,first_txn_date,last_txn_date,span_days,num_bins,bin_days,amount_bins,count_bins\n"
                        "a1,m1,5.5,2,2025-01-01 00:00:00,2025-01-20 00:00:00,19,2,14,5;0.5,1;1\n"
                        "a1,a2,x,2,2025-01-01 00:00:00,2025-01-20 00:00:00,19,2,14,5;0.5,1;1\n"
                        "a2,a1,1,1,2025-01-01 00:00:00,2025-01-01 00:00:00,0,2,14,5;oops,1\n"
                        "a2,gone,1,1,2025-01-01 00:00:00,2025-01-01 00:00:00,0,1,14,1,1\n",
}


def folder(tmp_path, **instead):
    for name, f in exchange.VERTEX_FILES.items():
        text = PLAIN.get(name, f"{f.key}\nv1\nv2\nv1\n")
        (tmp_path / f"{name}.csv").write_text(instead.get(name, text))
    for name in (*exchange.EDGE_FILES, exchange.FLOWS):
        (tmp_path / f"{name}.csv").write_text(PLAIN.get(name, "FROM,TO\np1,v1\np2,v3\n"))
    return str(tmp_path)


def test_loads_the_folder(spark, tmp_path):
    assert len(exchange.VERTEX_FILES) == 17 and len(exchange.EDGE_FILES) + 1 == 15
    got = exchange.load(spark, folder(tmp_path))
    accounts = {r.id: r.asDict() for r in got.vertices["Account"].collect()}
    assert set(accounts) == {"a1", "a2", "x1", "m1"} and len(accounts["a1"]) == 48
    assert accounts["a2"]["fraud"] == 1 and accounts["a2"]["victim"] == 0 and accounts["a2"]["external_type"] == "wallet" and accounts["a2"]["category"] == ""
    assert accounts["m1"]["account_age_days"] == -1 and accounts["m1"]["category"] == "shop" and accounts["x1"]["category"] == "zoo"
    assert {r.id: r.is_blocked for r in got.vertices["Device"].collect()} == {"d1": 1, "d2": 0, "d3": 0}
    assert {r.id: r.is_blocked for r in got.vertices["IP"].collect()} == {"i1": 1, "i2": 0}
    assert sorted(r.id for r in got.vertices["City"].collect()) == ["v1", "v2"]
    assert [tuple(r) for r in got.edges["Has_Device"].select("from_id", "to_id", "first_seen", "last_seen").collect()] == [("p1", "d1", 1735689600, 1735862400)]
    assert sorted(tuple(r) for r in got.edges["Party_Has_Account"].select("from_id", "to_id").collect()) == [("p1", "a1"), ("p1", "x1")]
    flow = got.edges["HAS_PAID"].collect()
    assert len(flow) == 1 and flow[0].amount_bins == [5, .5] and flow[0].count_bins == [1, 1] and flow[0].txn_count == 2
    bad = {}
    for r in got.quarantine.collect():
        bad.setdefault(r.file, []).append((r.line, r.reasons))
    assert sorted(bad["accountnumber"]) == [(",1,1,1,1", ["no id"]), ("a3,x,0,0,y", ["mule is no long", "is_external is no long"]), ("a4,1,0", ["malformed line"])]
    assert sorted(x for _, x in bad["HAS_ACCOUNT"]) == [["no end"], ["no start"], ["to_id is no Account"]]
    assert [x for _, x in bad["HAS_IP"]] == [["from_id is no Party", "to_id is no IP"]] and [x for _, x in bad["HAS_USED"]] == [["first_seen is no time"]]
    assert sorted(x for _, x in bad["ACCOUNT_FLOW_AGG"]) == [["amount_bins is no list of double", "lists of different length"], ["to_id is no Account"], ["total_amount is no double"]]
    assert bad["HAS_CITY"] == [("p2,v3", ["to_id is no City"])] and "device" not in bad


def test_files_and_columns_must_be_there(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns"):
        exchange.load(spark, folder(tmp_path, device="device_id,device_type\nd1,x\n"))
    (tmp_path / "city.csv").unlink()
    (tmp_path / "device.csv").write_text(PLAIN["device"])
    with pytest.raises(Exception, match="city"):
        exchange.load(spark, str(tmp_path))
