"""Hand-made raw tables: one passing set, plus helpers to break exactly one rule."""

TELEMETRY = """datetime,machineID,volt,rotate,pressure,vibration
2015-01-01 06:00:00,1,176.2,418.5,113.1,45.1
2015-01-01 07:00:00,1,162.9,402.7,95.5,43.4
2015-01-01 08:00:00,1,170.0,527.3,75.2,34.2
2015-01-01 06:00:00,2,180.1,450.0,100.0,40.0
2015-01-01 07:00:00,2,181.1,451.0,101.0,41.0
"""
ERRORS = """datetime,machineID,errorID
2015-01-01 06:00:00,1,error1
2015-01-01 06:00:00,1,error3
2015-01-01 07:00:00,2,error1
2015-01-01 09:00:00,2,error2
"""
FAILURES = """datetime,machineID,failure
2015-01-01 07:00:00,1,comp1
2015-01-01 07:00:00,2,comp2
"""
MACHINES = """machineID,model,age
1,model3,18
2,model4,7
"""
MAINTENANCE = """datetime,machineID,comp
2015-01-01 06:00:00,1,comp1
2015-01-01 06:00:00,1,comp2
2015-01-01 08:00:00,1,comp4
"""

TABLES = {"telemetry": TELEMETRY, "errors": ERRORS, "failures": FAILURES, "machines": MACHINES,
          "maintenance": MAINTENANCE}


def write_all(write_csv, overrides=None, skip=()):
    folder = None
    for name, text in TABLES.items():
        if name in skip:
            continue
        folder = write_csv(name, (overrides or {}).get(name, text))
    return folder
