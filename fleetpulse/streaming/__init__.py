"""fleetpulse.streaming"""
