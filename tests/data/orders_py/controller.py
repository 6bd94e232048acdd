from service import OrderService
from models import Product


class OrderController:
    def __init__(self, service: OrderService):
        self.service = service

    def handle_create_order(self, payload):
        return self.service.create_order(payload["id"], Product(payload["sku"], 1.0), 1)
