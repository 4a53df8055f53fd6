"""fleetpulse.functions"""
