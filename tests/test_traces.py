from wirelens import catalog

SF = "/root/testdata/sf0.001"


def test_traces_hold_every_exchange(spark):
    shown = "".join(str(v) for r in catalog.QUERIES["otlp_traces_json"](spark, SF).collect() for v in r)
    assert shown.count('"spanId"') == catalog.exchanges(spark, SF).count() > 0


def test_documents_are_posted_by_tasks(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from wirelens.operators import export

    got = []

    class Sink(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200 if len(got) != 2 else 500)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Sink)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    documents = spark.createDataFrame([(f'{{"n":{k}}}',) for k in range(5)], "json string").coalesce(1)
    assert export.post(documents, f"http://127.0.0.1:{server.server_port}/v1/metrics") == {"sent": 4, "failed": 1}
    assert sorted(got) == [f'{{"n":{k}}}'.encode() for k in range(5)]
    assert export.post(documents.limit(0), "http://127.0.0.1:1/") == {"sent": 0, "failed": 0}
    server.shutdown()
