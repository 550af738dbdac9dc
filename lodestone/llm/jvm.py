"""Kernels that run inside the executors' JVM.

The sources in kernels/*.java are compiled on the driver by Janino, the compiler that Spark itself uses for generated
code, and sent to the executors as a jar (ADD JAR). A kernel is a function of one row that gets and returns binary
columns or arrays of them, so SQL keeps control of shuffles, joins and recovery.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).parent / "kernels"
#: Function name: class, result type as Spark writes it in JSON.
_done: dict[str, object] = {}


def register(spark: SparkSession, name: str, cls: str, returns: str) -> str:
    """Makes the kernel class callable as SQL function name; returns is a DDL type."""
    app = spark.sparkContext.applicationId
    gate, jvm = spark.sparkContext._gateway, spark._jvm
    thread = jvm.java.lang.Thread.currentThread()
    if app not in _done:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(thread.getContextClassLoader())
        lines = [line for p in sorted(HERE.glob("*.java")) for line in p.read_text().splitlines()]
        imports = sorted({x for x in lines if x.startswith("import ")})
        compiler.cook("\n".join(["package lodestone.kernel;", *imports, *(x for x in lines if not x.startswith(("import ", "package ")))]))
        codes = compiler.getBytecodes()
        jar = os.path.join(tempfile.mkdtemp(prefix="lodestone-jar-"), "lodestone-kernels.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for k in codes:
                z.writestr(k.replace(".", "/") + ".class", bytes(codes[k]))
        spark.sql(f"ADD JAR '{jar}'")
        _done.clear()
        _done[app] = thread.getContextClassLoader()
    thread.setContextClassLoader(_done[app])
    made = _done[app].loadClass(f"lodestone.kernel.{cls}").getDeclaredConstructor(gate.new_array(jvm.java.lang.Class, 0)).newInstance(gate.new_array(jvm.java.lang.Object, 0))
    spark._jsparkSession.udf().register(name, made, jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return name
