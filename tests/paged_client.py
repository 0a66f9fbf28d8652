"""A paged client for tests: three rows in each block."""


class Client:
    def page(self, lo, hi, offset, limit):
        rows = [{"codigoestacion": f"00{i}", "fechaobservacion": lo, "valorobservado": i} for i in range(3)]
        return rows[offset : offset + limit]


def make(options):
    return Client()
