"""Industrial-protocol traffic analytics (Modbus/TCP and DNP3) as PySpark DataFrame operators."""

__version__ = "0.1.0"
