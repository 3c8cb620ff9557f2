"""Golden mini-dataset (FIXTURES.md section 2), as JSON documents."""

import json

CPU = "platformProfile.sut.Summary.Server.CPUModel"
CORES = "platformProfile.sut.Summary.CPU.CPU(s)"


def masterlist_rows():
    def cpu(o, mid, status, value, family=None, cores=None):
        meta = None
        if family is not None:
            meta = {"Family": family, "mapping_Family": "processor_details.family",
                    "coreCount": cores, "mapping_coreCount": CORES}
        return (o, mid, "CPUModel", status, (value, CPU, meta))
    return [
        cpu(1, "m1", "Published", "7543", "Milan", "32"),
        cpu(2, "m2", "Published", "7543", "Milan", "64"),
        cpu(3, "m3", "Published", "9654P", "Genoa", "96"),
        (4, "m4", "instanceType", "Published", ("m6a.large", "sutInstanceMetadata.instanceType",
                                                {"cloudProvider": "AWS",
                                                 "mapping_cloudProvider": "sutInstanceMetadata.cloudProvider"})),
        (5, "m5", "Benchmark", "Published", ("SPEC CPU", "benchmarkCategory",
                                             {"BenchmarkType": "intrate", "mapping_benchmarkType": "benchmarkType"})),
        cpu(6, "m6", "Draft", "AMD 7543"),
    ]


ML_SCHEMA = ("ordinal bigint, ml_id string, type string, status string, "
             "data struct<value:string, mapping:string, metadata:map<string,string>>")


def doc(cpu=None, cores=None, sut="server", inst=None, cloud=None, bcat="SPEC CPU", btype="intrate",
        literal_sut=False):
    d = {"platformProfile": {"sut": {"Summary": {"Server": {}, "CPU": {"CPU(s)": cores}}}},
         "sutInstanceMetadata": {}, "benchmarkCategory": bcat, "benchmarkType": btype}
    if cpu is not None:
        d["platformProfile"]["sut"]["Summary"]["Server"]["CPUModel"] = cpu
    if literal_sut:
        d["sutInstanceMetadata.sutType"] = sut
    else:
        d["sutInstanceMetadata"]["sutType"] = sut
    if inst is not None:
        d["sutInstanceMetadata"]["instanceType"] = inst
    if cloud is not None:
        d["sutInstanceMetadata"]["cloudProvider"] = cloud
    return json.dumps(d)


def execution_rows():
    return [
        ("e1", doc("7543", "64", literal_sut=True)),
        ("e2", doc("7543", "48")),
        ("e3", doc("AMD 7543", "32")),
        ("e4", doc("9654P", "96", sut="Cloud", inst="m6a-large", cloud="AWS")),
        ("e5", doc(None, "32")),
        ("e6", doc("7543", "032", bcat="spec cpu", btype="INTRATE")),
    ]


PROC_ROWS = [("7543", "Milan", 1), ("9654P", "Genoa", 2)]
