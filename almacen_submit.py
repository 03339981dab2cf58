"""Launcher for spark-submit (which runs a file, not ``-m module``).

    zip -r almacen.zip almacen
    spark-submit --properties-file conf/spark-cluster.conf --py-files almacen.zip \
        almacen_submit.py build --csv hdfs:///landing/invoice_lines/ --out hdfs:///warehouse/almacen/star
"""

from almacen.__main__ import main

if __name__ == "__main__":
    raise SystemExit(main())
